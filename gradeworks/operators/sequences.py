"""Operators along an order: gaps, moving means, bands, segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.sources.scratch import written


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with ``__part``, the number of their range of (keys, order): a key with very many rows lies in several, in order."""
    return written(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranged")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """That two tables' keys are alike, nulls too; the right side's bear a ``__`` in front."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"__{k}"]) for k in keys))


def gaps(df: DataFrame, key: str, start: str, end: str, name: str = "gap") -> DataFrame:
    """Seconds from the end of the row before to this row's start within a key, not below 0; null for the first.

    Rows are ordered range by range, so a key of any size is many tasks' work; the
    end of a range's last row is handed to the key's next range.
    """
    rows = ranged(df, [key], [start, end])
    last = rows.groupBy(key, "__part").agg(F.max(F.struct(start, end)).alias("l"))
    handed = F.lag(F.col("l").getField(end)).over(Window.partitionBy(key).orderBy("__part"))  # a row for each range of a key
    edges = last.select(F.col(key).alias(f"__{key}"), F.col("__part").alias("__at"), handed.alias("__handed"))
    joined = rows.join(edges, same(rows, edges, [key]) & (F.col("__part") == F.col("__at")))
    before = F.coalesce(F.lag(end).over(Window.partitionBy(key, "__part").orderBy(start, end)), "__handed")
    return joined.withColumn(name, F.when(before.isNotNull(), F.greatest(F.col(start) - before, F.lit(0.0)))).drop(f"__{key}", "__part", "__at", "__handed")


def pause_rates(timed: DataFrame, key: str, start: str, end: str, short: float, long: float) -> DataFrame:
    """Rates of a key's timed words: counts and seconds of gaps above the bounds, words a spoken second."""
    g = gaps(timed, key, start, end)
    over = F.col("gap") > short
    seconds = F.greatest(F.max(end) - F.min(start), F.lit(1.0))
    out = g.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(F.greatest(F.col(end) - F.col(start), F.lit(0.0))).alias("spoken"), seconds.alias("seconds"),
        F.count_if(over).alias("pauses"), F.count_if(F.col("gap") > long).alias("long_pauses"), F.sum(F.when(over, F.col("gap"))).alias("paused"),
    )
    minutes = F.col("seconds") / 60
    return out.select(
        key, (F.col("n") / F.greatest(F.col("spoken"), F.lit(1e-3))).alias("articulation_rate"), (F.col("pauses") / minutes).alias("pause_per_min"),
        (F.col("long_pauses") / minutes).alias("long_pause_per_min"), F.coalesce(F.col("paused") / F.when(F.col("pauses") > 0, F.col("pauses")), F.lit(0.0)).alias("mean_pause_s"),
        (F.coalesce("paused", F.lit(0.0)) / F.col("seconds")).alias("pause_time_frac"),
    )


def moving_mean(df: DataFrame, keys: list[str], order: str, x: str, width: int, name: str = "moving") -> DataFrame:
    """Mean of ``width`` rows from each on; rows whose frame is not full are left out.

    Rows are ordered range by range, so a key of any size is many tasks' work; each
    range also gets the ``width - 1`` rows of its key that follow it.
    """
    rows = ranged(df, keys, [order])
    here = Window.partitionBy(*keys, "__part").orderBy(order)
    heads = rows.withColumn("__r", F.row_number().over(here)).where(F.col("__r") < width)
    # a key's heads are few: less than the width for each of its ranges
    heads = written(heads.select(*keys, order, x, "__part", F.row_number().over(Window.partitionBy(*keys).orderBy("__part", "__r")).alias("__h")), "heads")
    wanted = heads.groupBy(*keys, "__part").agg(F.max("__h").alias("__last")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__to"), F.explode(F.sequence(F.col("__last") + 1, F.col("__last") + width - 1)).alias("__at")) if width > 1 else None
    both = rows.withColumn("__own", F.lit(True))
    if wanted is not None:
        carried = heads.join(wanted, same(heads, wanted, keys) & (F.col("__h") == F.col("__at"))).select(*keys, order, x, F.col("__to").alias("__part"), F.lit(False).alias("__own"))
        both = both.unionByName(carried, allowMissingColumns=True)
    frame = Window.partitionBy(*keys, "__part").orderBy(order, F.desc("__own")).rowsBetween(0, width - 1)
    out = both.withColumns({name: F.avg(x).over(frame), "__n": F.count("*").over(frame)})
    return out.where(F.col("__own") & (F.col("__n") == width)).drop("__n", "__own", "__part")


def best_bands(df: DataFrame, keys: list[str], order: str, x: str, width: int = 4) -> DataFrame:
    """Start and end (exclusive) of the band with the least mean, and of the best one that does not overlap it (null if none is left)."""
    moving = moving_mean(df, keys, order, x, width)
    first = Window.partitionBy(*keys).orderBy("moving", order)
    a = moving.withColumn("r", F.row_number().over(first)).where("r = 1").select(*keys, F.col(order).alias("a_start"))
    apart = moving.join(a, keys).where((F.col(order) <= F.col("a_start") - width) | (F.col(order) >= F.col("a_start") + width))
    b = apart.withColumn("r", F.row_number().over(first)).where("r = 1").select(*keys, F.col(order).alias("b_start"))
    return a.join(b, keys, "left").select(*keys, "a_start", (F.col("a_start") + width).alias("a_end"), "b_start", (F.col("b_start") + width).alias("b_end"))


def tumbling(df: DataFrame, key: str, t: str, width: float, least_tail: float) -> DataFrame:
    """Rows with ``window`` from the key's first time on; a key's last window goes if it lasts less than ``least_tail``."""
    span = df.groupBy(key).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"))
    out = df.join(span, key).withColumn("window", F.floor((F.col(t) - F.col("__t0")) / width).cast("long"))
    tail = (F.col("__t1") - F.col("__t0")) - F.floor((F.col("__t1") - F.col("__t0")) / width) * width
    last = F.col("window") == F.floor((F.col("__t1") - F.col("__t0")) / width).cast("long")
    return out.where(~(last & (tail < least_tail) & (F.col("window") > 0))).drop("__t0", "__t1")


def segment_means(df: DataFrame, key: str, array: str, segments: int) -> DataFrame:
    """``key, segment, mean`` of ``segments`` runs of an array, between evenly spaced edges rounded half to even.

    A run without a value takes the one at its edge, so every array that is not
    empty has all segments.
    """
    n = F.size(array)
    edge = lambda j: F.rint(j * (n / F.lit(segments))).cast("int")

    def mean(j):
        a, b = F.least(edge(j), n - 1), edge(j + 1)
        run = F.slice(array, a + 1, F.greatest(b - a, F.lit(1)))
        return F.aggregate(run, F.lit(0.0), lambda s, x: s + x) / F.size(run)

    means = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), mean)
    return df.where(n > 0).select(key, F.posexplode(means).alias("segment", "mean"))

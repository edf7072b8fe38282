"""Bins, histograms and sample weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.sources.scratch import written


def values_at(df: DataFrame, x: str, ranks: list[int], counted: DataFrame | None = None) -> dict[int, float]:
    """The values at some ranks (from 0) of a column in order, exactly.

    Values are counted, dealt out in ranges of values and numbered by a running
    count within a range after the counts of the ranges before it. Only a row
    for each range and for each asked rank comes to the driver.
    """
    counted = counted if counted is not None else value_counts(df, x)
    sizes = sorted((r["part"], r["n"]) for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, start = 0, []
    for part, n in sizes:
        start.append((part, before))
        before += n
    if not start or not ranks:
        return {}
    offset = F.broadcast(df.sparkSession.createDataFrame(start, "part int, start long"))
    placed = counted.join(offset, "part").withColumn("above", F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    wanted = F.explode(F.filter(F.array(*[F.lit(r).cast("long") for r in sorted(set(ranks))]), lambda r: (r < F.col("above")) & (r >= F.col("above") - F.col("n"))))
    return {r["rank"]: r["v"] for r in placed.select(wanted.alias("rank"), "v").collect()}


def value_counts(df: DataFrame, x: str) -> DataFrame:
    """``v, n, part``: how often each value stands, in ranges of values that are numbered in order."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count("*").alias("n"))
    return written(counts.repartitionByRange(F.col("v")).withColumn("part", F.spark_partition_id()), "value-counts")


def ranged_counts(df: DataFrame, key: str, x: str) -> DataFrame:
    """``k, v, n, part``: how often each value stands in its group, in ranges of (group, value); a large group spreads over many."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(key).alias("k"), F.col(x).cast("double").alias("v")).agg(F.count("*").alias("n"))
    return written(counts.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "ranged-counts")


def group_quantiles(df: DataFrame, key: str, x: str, shares: list[float]) -> DataFrame:
    """``key, n, q``: exact quantiles of every group (linear interpolation), as an array in the order of the shares; nulls are left out.

    A value's ranks follow from a running count within its range, after the counts
    of the group's ranges before it. No task holds a group: what is summed up by
    group are the few values at the asked ranks, combined before the shuffle.
    """
    counts = ranged_counts(df, key, x)
    sizes = counts.groupBy("k", "part").agg(F.sum("n").alias("c"))
    group = Window.partitionBy("k")  # a row for each range of a group
    starts = sizes.select(F.col("k").alias("g"), F.col("part").alias("at"), (F.sum("c").over(group.orderBy("part")) - F.col("c")).alias("start"), F.sum("c").over(group).alias("total"))
    placed = counts.join(starts, F.col("k").eqNullSafe(F.col("g")) & (F.col("part") == F.col("at")))
    above = F.col("start") + F.sum("n").over(Window.partitionBy("k", "part").orderBy("v"))
    placed = placed.select("k", "v", "total", above.alias("above"), (above - F.col("n")).alias("first"))
    holds = lambda rank: (rank >= F.col("first")) & (rank < F.col("above"))

    def value(share: float) -> Column:
        place = F.lit(share) * (F.col("total") - 1)
        part = place - F.floor(place)
        weight = F.when(holds(F.floor(place)), 1 - part).otherwise(0.0) + F.when(holds(F.floor(place) + 1), part).otherwise(0.0)
        return F.sum(F.when(weight > 0, F.col("v") * weight).otherwise(0.0))

    return placed.groupBy(F.col("k").alias(key)).agg(F.max("total").alias("n"), F.array(*[value(s) for s in shares]).alias("q"))


def quantile_edges(df: DataFrame, x: str, bins: int, accuracy: int | None = None) -> list[float]:
    """Distinct edges of ``bins`` quantile bins (linear interpolation), rounded to settle the last digits; ``accuracy`` asks for a sketch of that size instead."""
    shares = [i / bins for i in range(bins + 1)]
    if accuracy:
        return sorted({round(e, 9) for e in df.agg(F.percentile_approx(x, shares, accuracy).alias("e")).first()["e"] or []})
    counted = value_counts(df, x)
    n = counted.agg(F.sum("n")).first()[0] or 0
    places = [s * (n - 1) for s in shares] if n else []
    at = values_at(df, x, [r for p in places for r in (math.floor(p), math.ceil(p))], counted)
    return sorted({round(at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)), 9) for p in places})


def quantile_bins(df: DataFrame, x: str, bins: int, name: str = "bin", accuracy: int | None = None) -> DataFrame:
    """Right-closed quantile bins; the lowest value falls into the first. Edges that coincide make one."""
    edges = quantile_edges(df, x, bins, accuracy)
    above = sum((F.when(F.col(x) > e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn(name, F.when(F.col(x).isNotNull(), F.greatest(F.lit(0), above - 1)))


def equal_bins(df: DataFrame, x: str, bins: int, name: str = "bin") -> DataFrame:
    """Right-closed bins of equal width between the least and the largest value; all 0 where they coincide."""
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None or low == high:
        return df.withColumn(name, F.when(F.col(x).isNotNull(), 0))
    place = F.ceil((F.col(x) - low) / (high - low) * bins).cast("int")
    return df.withColumn(name, F.greatest(F.lit(1), place) - 1)


def histogram(df: DataFrame, bin_: str, bins: int) -> DataFrame:
    """Counts of all bins from 0, zero where there is none."""
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias(bin_))
    return spine.join(F.broadcast(df.groupBy(bin_).count()), bin_, "left").select(bin_, F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def rarity_weights(df: DataFrame, bin_: str, power: float = 0.5, name: str = "weight") -> DataFrame:
    """``(1 / bin count) ** power``, scaled to mean 1. There are few bins, so their weights are broadcast."""
    counts = df.groupBy(bin_).agg(F.count("*").alias("__n")).withColumn("__w", F.pow(1 / F.col("__n"), F.lit(power)))
    total = counts.agg((F.sum(F.col("__n") * F.col("__w")) / F.sum("__n")).alias("__m"))
    return df.join(F.broadcast(counts.crossJoin(F.broadcast(total)).withColumn(name, F.col("__w") / F.col("__m")).select(bin_, name)), bin_)


def importance_weights(train: DataFrame, test: DataFrame, group: str, name: str = "weight") -> DataFrame:
    """Share of a group in the test rows over its share in the training rows, scaled to mean 1 over the training rows."""
    share = lambda df, c: df.groupBy(group).count().crossJoin(F.broadcast(df.agg(F.count("*").alias("t")))).select(group, (F.col("count") / F.col("t")).alias(c), F.col("count").alias(f"n_{c}"))
    both = share(train, "p").join(share(test, "q"), group, "left").withColumn("__w", F.coalesce("q", F.lit(0.0)) / F.greatest(F.col("p"), F.lit(1e-9)))
    mean = both.agg((F.sum(F.col("__w") * F.col("n_p")) / F.sum("n_p")).alias("__m"))
    return train.join(F.broadcast(both.crossJoin(F.broadcast(mean)).withColumn(name, F.col("__w") / F.col("__m")).select(group, name)), group)


def one_hot(df: DataFrame, column: str, values: list, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in values})

"""An extension over event streams; the surveyed pipeline is all batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, key, n, total`` of tumbling windows; state older than the watermark is let go.

    Works on a stream and on a table alike; a row without a time is in no window.
    """
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).where("__ts is not null")
    if events.isStreaming:
        timed = timed.withWatermark("__ts", late)
    out = timed.groupBy(F.window("__ts", width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def first_seen(events: DataFrame, ts: str, ident: str, late: str = "2 hours") -> DataFrame:
    """Each id once within the watermark, for sources that deliver a row again."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        return timed.withWatermark("__ts", late).dropDuplicatesWithinWatermark([ident]).drop("__ts")
    return timed.dropDuplicates([ident]).drop("__ts")

"""Vector expressions over array columns, and means by dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def mean_vector(df: DataFrame, vec: str, *keys: str) -> DataFrame:
    """The mean of each dimension as one array, for each key; dimensions are summed apart, so partial sums are short rows."""
    each = df.select(*keys, F.posexplode(doubles(F.col(vec))).alias("d", "x")).groupBy(*keys, "d").agg(F.avg("x").alias("m"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("center"))


def centred_unit(df: DataFrame, vec: str, center: DataFrame) -> DataFrame:
    """``vec`` minus the center, scaled to length 1; a zero vector stays zero. The center is one row."""
    out = df.crossJoin(F.broadcast(center)).withColumn("__c", F.zip_with(doubles(F.col(vec)), F.col("center"), lambda x, m: x - m))
    n = norm(F.col("__c"))
    return out.withColumn(vec, F.transform("__c", lambda x: F.when(n > 0, x / n).otherwise(x))).drop("__c", "center")

"""Evaluation metrics as aggregate columns: one pass, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def rmse(y: Column, p: Column, w: Column | None = None) -> Column:
    if w is None:
        return F.sqrt(F.avg((y - p) * (y - p)))
    return F.sqrt(safe_ratio(F.sum(w * (y - p) * (y - p)), F.sum(w)))


def pearson(y: Column, p: Column, w: Column | None = None) -> Column:
    """Correlation from population moments; 0 where a side does not vary."""
    if w is None:
        vy, vp, c = F.var_pop(y), F.var_pop(p), F.covar_pop(y, p)
    else:
        total = F.sum(w)
        my, mp = safe_ratio(F.sum(w * y), total), safe_ratio(F.sum(w * p), total)
        vy, vp = safe_ratio(F.sum(w * y * y), total) - my * my, safe_ratio(F.sum(w * p * p), total) - mp * mp
        c = safe_ratio(F.sum(w * y * p), total) - my * mp
    return F.when((vy <= 0) | (vp <= 0), 0.0).otherwise(c / F.sqrt(F.when((vy > 0) & (vp > 0), vy * vp)))


def composite(error: Column, r: Column, a: float = 0.6, b: float = 0.4) -> Column:
    """Lower is better: a times the error plus b times what correlation lacks."""
    return a * error + b * (1 - r)


def composite_equal(error: Column, r: Column) -> Column:
    return composite(error, r, 0.5, 0.5)


def report(df: DataFrame, keys: list[str], y: str, p: str, w: str | None = None) -> DataFrame:
    """``n, rmse, pearson, composite, bias`` of each group (of all rows without keys)."""
    wc = F.col(w) if w else None
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), rmse(F.col(y), F.col(p), wc).alias("rmse"), pearson(F.col(y), F.col(p), wc).alias("pearson"), F.avg(F.col(p) - F.col(y)).alias("bias")
    )
    return out.withColumn("composite", composite(F.col("rmse"), F.col("pearson")))

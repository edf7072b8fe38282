"""Column expressions for masks, buckets and clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def gate(a: Column, above: float, b: Column, below: float) -> Column:
    """Both conditions, strictly."""
    return (a > above) & (b < below)


def bucket(x: Column, cuts: list[float]) -> Column:
    """The number of the first cut that x is below, len(cuts) if none; NaN counts as above all, null stays null."""
    out = F.when(x < cuts[0], 0)
    for i, c in enumerate(cuts[1:], 1):
        out = out.when(x < c, i)
    return out.when(x.isNotNull(), len(cuts))


def flag(x: Column, value) -> Column:
    """Whether x has the value; null has not."""
    return F.coalesce(x == value, F.lit(False))


def softmax_terms(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  (the array of one makes the value once)
    raised = lambda given: bound(F.array_max(given), lambda top: F.transform(given, lambda x: F.exp(x - top)))
    shares = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    return bound(logits, lambda given: bound(raised(given), shares))


def expected(probabilities: Column) -> Column:
    """Mean of 1, 2, 3, ... under the probabilities."""
    return F.aggregate(F.transform(probabilities, lambda p, i: p * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def entropy(probabilities: Column) -> Column:
    return -F.aggregate(F.transform(probabilities, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def epoch(ts: str) -> Column:
    """Seconds since 1970 of a time without a zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 1e6D")


def hashed_unit(*whole: Column) -> Column:
    """A repeatable number in [0, 1) from integers, in arithmetic that any SQL engine has."""
    mixed = F.lit(12345).cast("long")
    for x in whole:
        mixed = F.pmod(mixed * 7919 + x.cast("long") * 104729 + 17, F.lit(1000003))
    return mixed / F.lit(1000003.0)

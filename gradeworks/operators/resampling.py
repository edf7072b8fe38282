"""Bootstrap intervals without moving or multiplying rows: each row is drawn a hashed number of times in each resample.

The draws are Poisson(1) counts, the limit of drawing n of n rows. A resample is a
weighted aggregate, and one pass makes all of them. A row's draws hang on the
remainder of its hash alone, so a task first adds up its rows' moments by remainder;
then few remainders' draws are looked up for all resamples at once and multiplied with
their moments, and many remainders' are added up by a Fourier transform, whose work
does not grow with rows or resamples. What is shuffled is a row a task and resample,
whatever the rows. Draws come from whole-number arithmetic, so any engine gives the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.functions import metrics
from gradeworks.functions.scalars import hashed_unit

#: Cumulative Poisson(1) probabilities of 0, 1, ... draws.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)
#: What ``hashed_unit`` multiplies, adds and divides by.
SEED, MIX, STEP, ADD, MODULUS = 12345, 7919, 104729, 17, 1000003
#: Remainders and resamples that are multiplied at once, and remainders up to which a task multiplies.
ROWS, TIMES, FEW = 512, 1024, 1 << 16


def draws(ident: Column, resample: Column) -> Column:
    """How often a row is drawn in a resample: what ``drawn`` looks up, as an expression."""
    u = hashed_unit(ident, resample)
    out = F.when(u < POISSON[0], 0.0)
    for k, p in enumerate(POISSON[1:], 1):
        out = out.when(u < p, float(k))
    return out.otherwise(float(len(POISSON)))


def drawn() -> np.ndarray:
    """The number of draws for each remainder of the hash."""
    return np.searchsorted(POISSON, np.arange(MODULUS) / MODULUS, side="right").astype(np.float32)


def turned_sums(table: np.ndarray, sums: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each row of ``sums`` and each ``b`` in ``second``, ``sum over a of table[(a + b) % MODULUS] * row[a]``, by the transform of all ``b``."""
    size = 1 << (2 * MODULUS).bit_length()  # the table twice, so that no place wraps
    turned = np.fft.rfft(np.concatenate([table, table]), size)
    return np.array([np.fft.irfft(turned * np.conj(np.fft.rfft(row, size)), size)[second] for row in sums])


def repeated_sums(df: DataFrame, ident: str, y: str, predictions: list[str], times: int, tables: list[np.ndarray], w: str | None = None) -> DataFrame:
    """``resample, part, w, wy, wyy`` and, for each prediction, ``e_, p_, pp_, yp_``: weighted sums of every resample.

    A row's weight in a resample is what its part's table has for the remainder of
    the row's and the resample's hash, times ``w``.
    """
    few = FEW  # as it is now, on executors too
    columns = ["w", "wy", "wyy", *[f"{kind}_{p}" for p in predictions for kind in ("e", "p", "pp", "yp")]]
    twice = [np.concatenate([t, t]).astype(np.float32) for t in tables]

    def work(batches):
        second = (np.arange(times, dtype=np.int64) * STEP + ADD) % MODULUS
        total = np.zeros((len(tables), times, len(columns)))
        by_first, seen = np.zeros((len(columns), MODULUS)), np.zeros(MODULUS, dtype=bool)
        for b in batches:
            i, yy, ww = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            first = (SEED * MIX + i % MODULUS * STEP + ADD) % MODULUS * MIX % MODULUS
            sums = [ww, ww * yy, ww * yy * yy]
            for p in (b.column(k).to_numpy() for k in range(3, b.num_columns)):
                sums += [ww * (yy - p) ** 2, ww * p, ww * p * p, ww * yy * p]
            for c, v in enumerate(sums):
                np.add.at(by_first[c], first, v)
            seen[first] = True
        held = np.flatnonzero(seen)
        if len(held) > few:
            for part, table in enumerate(tables):
                total[part] = turned_sums(table.astype(np.float64), by_first, second).T
        for at in range(0, len(held) if len(held) <= few else 0, ROWS):
            some = held[at : at + ROWS]
            for r in range(0, times, TIMES):
                place = second[r : r + TIMES, None] + some[None, :]
                for part, table in enumerate(twice):
                    total[part, r : r + TIMES] += table[place].astype(np.float64) @ by_first[:, some].T
        for part in range(len(tables)):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(times)), pa.array(np.full(times, part, dtype=np.int32)), *[pa.array(c) for c in total[part].T]], names=["resample", "part", *columns])

    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = df.select(F.col(ident).cast("long").alias("i"), F.col(y).cast("double").alias("y"), weight.alias("w"), *[F.col(p).cast("double").alias(f"p{k}") for k, p in enumerate(predictions)])
    rows = rows.dropna()
    each = rows.mapInArrow(work, f"resample long, part int, {', '.join(f'{c} double' for c in columns)}")
    return each.groupBy("resample", "part").agg(*[F.sum(c).alias(c) for c in columns])


def composite_of_sums(p: str) -> Column:
    """The composite of a prediction from its row of sums."""
    mean = lambda c: metrics.safe_ratio(F.col(c), F.col("w"))
    vy, vp, c = mean("wyy") - mean("wy") * mean("wy"), mean(f"pp_{p}") - mean(f"p_{p}") * mean(f"p_{p}"), mean(f"yp_{p}") - mean("wy") * mean(f"p_{p}")
    r = F.when((vy <= 0) | (vp <= 0), 0.0).otherwise(c / F.sqrt(F.when((vy > 0) & (vp > 0), vy * vp)))
    return metrics.composite(F.sqrt(mean(f"e_{p}")), r)


def resampled(df: DataFrame, ident: str, y: str, predictions: list[str], times: int, w: str | None = None) -> DataFrame:
    """Composite of each prediction in each resample: ``resample, <prediction>...``. Rows with a null in any of these columns are left out."""
    return repeated_sums(df, ident, y, predictions, times, [drawn()], w).select("resample", *[composite_of_sums(p).alias(p) for p in predictions])


def splits(df: DataFrame, ident: str, y: str, predictions: list[str], times: int, share: float) -> DataFrame:
    """Composite of each prediction on both parts of each random split: ``resample, part`` (0 holds the share) ``, <prediction>...``."""
    inside = (np.arange(MODULUS) / MODULUS < share).astype(np.float32)
    return repeated_sums(df, ident, y, predictions, times, [inside, 1 - inside]).select("resample", "part", *[composite_of_sums(p).alias(p) for p in predictions])


def interval(scores: DataFrame, name: str, level: float = 0.95) -> DataFrame:
    """``low, mid, high`` of a column of resampled scores."""
    return scores.agg(*[F.percentile(name, F.lit(q)).alias(c) for c, q in (("low", (1 - level) / 2), ("mid", 0.5), ("high", (1 + level) / 2))])


def paired(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference b - a over the same resamples, its interval, and how often b is better (lower)."""
    d = F.col(b) - F.col(a)
    return scores.agg(F.avg(d).alias("delta"), F.percentile(d, F.lit(0.025)).alias("low"), F.percentile(d, F.lit(0.975)).alias("high"), F.avg(F.when(d < 0, 1.0).otherwise(0.0)).alias("p_better"))

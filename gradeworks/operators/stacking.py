"""Non-negative stacking, calibration, smoothing and label priors, fitted on sums."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.functions import metrics
from gradeworks.operators.heads import grams
from gradeworks.operators.kernels import array_sums, filled, matrix


def nnls(gram: np.ndarray) -> tuple[np.ndarray, float]:
    """Non-negative weights and free intercept from sums of ``[1, p..., y]``, by the active-set method on the normal equations."""
    n, d = gram[0, 0], len(gram) - 2
    mx, my = gram[0, 1 : d + 1] / n, gram[0, -1] / n
    a = gram[1 : d + 1, 1 : d + 1] - n * np.outer(mx, mx)
    b = gram[1 : d + 1, -1] - n * mx * my
    free, c = np.zeros(d, dtype=bool), np.zeros(d)
    for _ in range(30 * d):
        slope = b - a @ c
        if free.all() or slope[~free].max() <= 1e-10 * max(1.0, np.abs(b).max()):
            break
        free[int(np.argmax(np.where(free, -np.inf, slope)))] = True
        while True:
            trial = np.zeros(d)
            trial[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free], rcond=None)[0]
            if (trial[free] > 0).all():
                c = trial
                break
            down = free & (trial <= 0)
            step = np.min(c[down] / np.maximum(c[down] - trial[down], 1e-300))
            c = c + step * (trial - c)
            free &= c > 1e-12
            c[~free] = 0.0
    return c, float(my - mx @ c)


def calibration(df: DataFrame, group: str, raw: str, y: str, w: str | None = None) -> DataFrame:
    """``group, a, b`` of ``y = b * raw + a[group]``: one slope, an intercept a group, from group sums."""
    wc = F.col(w) if w else F.lit(1.0)
    sums = df.groupBy(group).agg(F.sum(wc).alias("n"), F.sum(wc * F.col(raw)).alias("x"), F.sum(wc * F.col(y)).alias("y"), F.sum(wc * F.col(raw) * F.col(raw)).alias("xx"), F.sum(wc * F.col(raw) * F.col(y)).alias("xy"))
    slope = sums.agg(metrics.safe_ratio(F.sum(F.col("xy") - F.col("x") * F.col("y") / F.col("n")), F.sum(F.col("xx") - F.col("x") * F.col("x") / F.col("n"))).alias("b"))
    return sums.crossJoin(F.broadcast(slope)).select(group, (F.col("y") / F.col("n") - F.col("b") * F.col("x") / F.col("n")).alias("a"), "b")


def calibrated(df: DataFrame, fitted: DataFrame, group: str, raw: str, name: str = "pred") -> DataFrame:
    """Apply a calibration; a group that it lacks gets the mean intercept of the others. It has one row a group."""
    mean = fitted.agg(F.avg("a").alias("__a"), F.first("b").alias("__b"))
    out = df.join(F.broadcast(fitted.select(group, "a")), group, "left").crossJoin(F.broadcast(mean))
    return out.withColumn(name, F.col("__b") * F.col(raw) + F.coalesce("a", "__a")).drop("a", "__a", "__b")


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """``a, b`` of the least-squares line ``y = a + b x``."""
    return df.agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"))


def composite_of(gram: np.ndarray, coef: np.ndarray, intercept: float) -> float:
    """0.6 RMSE + 0.4 (1 - r) of a linear prediction, from the sums alone."""
    n = gram[0, 0]
    p = np.concatenate(([intercept], coef, [0.0]))
    y = np.zeros(len(gram))
    y[-1] = 1
    one = np.zeros(len(gram))
    one[0] = 1
    mp, my = p @ gram @ one / n, y @ gram @ one / n
    vp, vy, c = p @ gram @ p / n - mp * mp, y @ gram @ y / n - my * my, p @ gram @ y / n - mp * my
    error = np.sqrt(max(vp + vy - 2 * c + (mp - my) ** 2, 0))
    r = c / np.sqrt(vp * vy) if vp > 0 and vy > 0 else 0.0
    return float(0.6 * error + 0.4 * (1 - r))


def moments_of(gram: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Sums ``n, p, y, pp, py, yy`` of a linear prediction, from the sums of ``[1, x..., y]``."""
    n, y = gram[0, 0], gram[-1]
    return np.array([n, line @ gram[0], y[0], line @ gram @ line, line @ y, y[-1]])


def composite_of_moments(m: np.ndarray) -> float:
    """0.6 RMSE + 0.4 (1 - r) from the sums ``n, p, y, pp, py, yy``."""
    n, p, y, pp, py, yy = m
    vp, vy, c = pp / n - (p / n) ** 2, yy / n - (y / n) ** 2, py / n - p * y / n**2
    # below this a variance is rounding
    flat = min(vp / max(pp / n, 1e-300), vy / max(yy / n, 1e-300)) < 1e-12
    r = 0.0 if flat else c / np.sqrt(vp * vy)
    return float(0.6 * np.sqrt(max((pp - 2 * py + yy) / n, 0)) + 0.4 * (1 - r))


@dataclass
class Stack:
    """Non-negative weights and an intercept, then one slope and an intercept for each population."""

    coef: np.ndarray
    intercept: float
    slope: float = 1.0
    levels: dict = field(default_factory=dict)

    def line(self, population) -> np.ndarray:
        """Intercept and weights for a row of a population; one that the fit lacked gets the mean intercept of the others."""
        level = self.levels.get(population, float(np.mean(list(self.levels.values()))) if self.levels else 0.0)
        return np.concatenate(([self.slope * self.intercept + level], self.slope * self.coef))


def fitted_stack(train: dict, columns: tuple[int, ...]) -> Stack:
    """The stack of some of the models, from the sums of each population's rows (one population ``None`` where there are none)."""
    size = len(next(iter(train.values()))) - 2
    at = np.ix_(pick := [0, *[c + 1 for c in columns], size + 1], pick)
    sums = {q: g[at] for q, g in train.items() if g[0, 0] > 0}
    coef, intercept = nnls(sum(sums.values()))
    whole = np.zeros(size)
    whole[list(columns)] = coef
    if list(train) == [None]:  # least squares with a free intercept is calibrated
        return Stack(whole, intercept)
    line = np.concatenate(([intercept], coef, [0.0]))
    moments = {q: moments_of(g, line) for q, g in sums.items()}
    xy = sum(m[4] - m[1] * m[2] / m[0] for m in moments.values())
    xx = sum(m[3] - m[1] * m[1] / m[0] for m in moments.values())
    slope = float(xy / xx) if xx > 0 else 0.0
    return Stack(whole, intercept, slope, {q: float((m[2] - slope * m[1]) / m[0]) for q, m in moments.items()})


def sums_by_fold(df: DataFrame, x: str, y: str, fold: str, population: str | None = None, populations: int = 4, w: str | None = None) -> dict:
    """``{fold: {population: sums}}`` of one column of folds; populations are numbers from 0."""
    key = F.col(fold) * populations + F.col(population) if population else F.col(fold)
    out: dict = {}
    for k, g in grams(df.withColumn("__cell", key), x, y, "__cell", w).items():
        f, q = divmod(k, populations) if population else (k, None)
        out.setdefault(f, {})[q] = g
    return out


def fold_stacks(by_fold: dict, columns: tuple[int, ...]) -> dict[int, Stack]:
    """A stack for each fold, from the sums of all others."""
    out = {}
    for f in by_fold:
        train: dict = {}
        for other, groups in by_fold.items():
            for q, g in groups.items():
                if other != f:
                    train[q] = train.get(q, 0) + g
        out[f] = fitted_stack(train, columns)
    return out


def judged(df: DataFrame, x: str, y: str, folds: list[str], candidates: list[list[dict[int, Stack]]], population: str | None = None, w: str | None = None, bounds: tuple[float, float] = (1.0, 5.0)) -> np.ndarray:
    """Composites of many stacks in one pass: a row a candidate, first of the mean prediction over all columns of folds, then of each column's.

    ``candidates`` hold, for each column of folds, the stacks of its folds. Each
    row is predicted by the stacks that were fitted without its fold, within the
    bounds. A clip has no sums to follow from, so rows are read once, whatever the
    number of candidates; a task adds up six numbers for each score.
    """
    many, columns = len(candidates), len(folds)
    rows = df.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), (F.col(w) if w else F.lit(1.0)).cast("double").alias("w"), (F.col(population) if population else F.lit(0)).cast("int").alias("q"), *[F.col(f).cast("int").alias(f"f{i}") for i, f in enumerate(folds)])

    def add(batches):
        total = np.zeros((many, 1 + columns, 6))
        for b in filled(batches):
            xx, yy, ww, q = matrix(b.column(0)), *(b.column(c).to_numpy() for c in (1, 2, 3))
            one = np.column_stack([np.ones(len(xx)), xx])
            pred = np.zeros((1 + columns, len(xx), many))
            for s in range(columns):
                fold = b.column(4 + s).to_numpy()
                for f, group in {*zip(fold.tolist(), q.tolist(), strict=True)}:
                    own = (fold == f) & (q == group)
                    lines = np.array([c[s][f].line(group if population else None) for c in candidates])
                    pred[1 + s, own] = np.clip(one[own] @ lines.T, *bounds)
            pred[0] = pred[1:].mean(0)
            for s, p in enumerate(pred):
                total[:, s] += np.column_stack([np.full(many, ww.sum()), ww @ p, np.full(many, ww @ yy), ww @ (p * p), (ww * yy) @ p, np.full(many, ww @ (yy * yy))])
        return {0: total.ravel()}

    got = array_sums(rows, add, many * (1 + columns) * 6)
    if not got:
        return np.full((many, 1 + columns), np.nan)
    return np.array([[composite_of_moments(m) for m in row] for row in got[0].reshape(many, 1 + columns, 6)])


def nested(
    df: DataFrame, x: str, y: str, folds: list[str], population: str | None = None, w_fit: str | None = None, w_judge: str | None = None, bounds: tuple[float, float] = (1.0, 5.0), columns: tuple[int, ...] | None = None,
) -> tuple[float, list[float], list[dict[int, Stack]]]:
    """Composite of the mean out-of-fold prediction, composites of each column of folds, and the folds' stacks."""
    sums = [sums_by_fold(df, x, y, f, population, w=w_fit) for f in folds]
    size = max((len(g) - 2 for by in sums for groups in by.values() for g in groups.values()), default=0)
    stacks = [fold_stacks(by, columns if columns is not None else tuple(range(size))) for by in sums]
    score, *each = judged(df, x, y, folds, [stacks], population, w_judge, bounds)[0]
    return float(score), [float(v) for v in each], stacks


def pruned(
    df: DataFrame, x: str, y: str, folds: list[str], most: int = 15, tolerance: float = 1e-4, population: str | None = None, w_fit: str | None = None, w_judge: str | None = None, bounds: tuple[float, float] = (1.0, 5.0),
) -> list[tuple[tuple[int, ...], float]]:
    """The way from all models to those that stay: ``(models, composite)`` after each removal; the last entry is the result.

    All ways to leave out one more model are judged in one pass, and the best of
    them is taken as long as it costs at most the tolerance against the best
    composite so far, or more than ``most`` models are left.
    """
    sums = [sums_by_fold(df, x, y, f, population, w=w_fit) for f in folds]
    size = max((len(g) - 2 for by in sums for groups in by.values() for g in groups.values()), default=0)
    options, way = [tuple(range(size))], []
    while options and options[0]:
        scores = judged(df, x, y, folds, [[fold_stacks(by, c) for by in sums] for c in options], population, w_judge, bounds)[:, 0]
        least = int(scores.argmin())
        if way and len(way[-1][0]) <= most and scores[least] > min(s for _, s in way) + tolerance:
            break
        way.append((options[least], float(scores[least])))
        options = [tuple(c for c in options[least] if c != out) for out in options[least]] if len(options[least]) > 1 else []
    return way


def stacked(df: DataFrame, p: str, coef: np.ndarray, intercept: float, low: float, high: float, name: str = "pred") -> DataFrame:
    from gradeworks.functions.scalars import clip

    weights = F.array(*[F.lit(float(c)) for c in coef])
    raw = F.aggregate(F.zip_with(F.col(p), weights, lambda a, c: a * c), F.lit(float(intercept)), lambda s, v: s + v)
    return df.withColumn(name, clip(raw, low, high))


def smoothed(df: DataFrame, group: str, pred: str, strength: Column | float, name: str = "smooth") -> DataFrame:
    """Predictions pulled to their group's mean. The means come back by a join, so a large group is no single task's work."""
    means = df.groupBy(group).agg(F.avg(pred).alias("__m"))
    s = strength if isinstance(strength, Column) else F.lit(strength)
    return df.join(means, group).withColumn(name, (1 - s) * F.col(pred) + s * F.col("__m")).drop("__m")


def smoothing_grid(df: DataFrame, group: str, pred: str, y: str, steps: int = 10) -> DataFrame:
    """``strength, composite`` for strengths 0 to 1."""
    grid = df.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("strength"))
    means = df.groupBy(group).agg(F.avg(pred).alias("__m"))
    rows = df.join(means, group).crossJoin(F.broadcast(grid))
    out = rows.withColumn("__p", (1 - F.col("strength")) * F.col(pred) + F.col("strength") * F.col("__m"))
    return metrics.report(out, ["strength"], y, "__p").select("strength", "composite")


def with_prior(pred: Column, sim: Column, label: Column, threshold: Column | float, share: Column | float) -> Column:
    """Predictions pulled to the nearest row's label where the similarity is above the threshold (strictly)."""
    s = share if isinstance(share, Column) else F.lit(share)
    return F.when(sim > threshold, (1 - s) * pred + s * label).otherwise(pred)


def prior_grid(df: DataFrame, y: str, pred: str, sim: str, label: str, thresholds: list[float], shares: list[float]) -> DataFrame:
    """``threshold, share, affected, composite``; share 0 without a threshold is the baseline."""
    grid = [(None, 0.0), *[(float(t), float(m)) for t in thresholds for m in shares]]
    table = df.sparkSession.createDataFrame(grid, "threshold double, share double")
    rows = df.crossJoin(F.broadcast(table)).withColumn("__p", with_prior(F.col(pred), F.col(sim), F.col(label), F.col("threshold"), F.col("share")))
    hit = rows.groupBy("threshold", "share").agg(F.avg(F.when(F.col(sim) > F.col("threshold"), 1.0).otherwise(0.0)).alias("affected"))
    score = metrics.report(rows, ["threshold", "share"], y, "__p").select(F.col("threshold").alias("t"), F.col("share").alias("s"), "composite")
    return hit.join(score, F.col("threshold").eqNullSafe(F.col("t")) & (F.col("share") == F.col("s"))).select("threshold", "share", "affected", "composite")

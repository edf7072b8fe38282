"""Regression heads on sums that Spark makes in one pass: ridge over folds by Gram subtraction, kernel ridge by Fourier features, boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeworks.sources.scratch import written

#: The penalties of ridge, and the fewer ones of ridge on kernel features.
ALPHAS = tuple(float(a) for a in np.logspace(-1, 5, 25))
KERNEL_ALPHAS = tuple(float(a) for a in np.logspace(0, 5, 11))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix; numbers that are null become NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def grams(df: DataFrame, x: str, y: str, key: str, w: str | None = None) -> dict[int, np.ndarray]:
    """Weighted sums of products of ``[1, x..., y]`` for each value of ``key``.

    Each task adds up its rows, cells are summed by a shuffle of (key, cell),
    and the driver gets one (d+2) x (d+2) matrix a key, whatever the rows.
    """
    rows = df.select(F.col(key).cast("int").alias("k"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), (F.col(w) if w else F.lit(1.0)).cast("double").alias("w"))

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            k, yy, ww = (b.column(i).to_numpy() for i in (0, 2, 3))
            xx = matrix(b.column(1))
            z = np.column_stack([np.ones(len(xx)), xx, yy])
            for v in np.unique(k):
                m = k == v
                total[int(v)] = total.get(int(v), 0) + (z[m] * ww[m, None]).T @ z[m]
        for v, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(g.size, v, dtype=np.int32)), pa.array(np.arange(g.size, dtype=np.int32)), pa.array(g.ravel())], names=["k", "c", "v"])

    cells = rows.mapInArrow(add, "k int, c int, v double").groupBy("k", "c").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for k, part in cells.groupby("k"):
        d = int(round(np.sqrt(len(part))))
        out[int(k)] = part.sort_values("c")["v"].to_numpy().reshape(d, d)
    return out


def ridge(gram: np.ndarray, alphas: tuple[float, ...]) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) for every alpha from one factorisation of the centred sums."""
    n, d = gram[0, 0], len(gram) - 2
    mx, my = gram[0, 1 : d + 1] / n, gram[0, -1] / n
    xx = gram[1 : d + 1, 1 : d + 1] - n * np.outer(mx, mx)
    xy = gram[1 : d + 1, -1] - n * mx * my
    values, vectors = np.linalg.eigh(xx)
    turned = vectors.T @ xy
    return [(c := vectors @ (turned / (np.maximum(values, 0) + a)), float(my - mx @ c)) for a in alphas]


def squared_error(gram: np.ndarray, coef: np.ndarray, intercept: float) -> float:
    v = np.concatenate(([intercept], coef, [-1.0]))
    return float(v @ gram @ v)


def scaled(gram: np.ndarray, plain: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums after each x is standardised by its mean and population deviation over the rows (1e-6 is added to it).

    ``plain`` are the sums without weights, where ``gram`` has weights: rows count
    alike for mean and deviation, and weights are divided by their mean, so that
    only their proportions matter.
    """
    plain = gram if plain is None else plain
    n, d = plain[0, 0], len(plain) - 2
    mean = plain[0, 1 : d + 1] / n
    sd = np.sqrt(np.maximum(np.diag(plain)[1 : d + 1] / n - mean * mean, 0)) + 1e-6
    t = np.eye(d + 2)
    t[0, 1 : d + 1] = -mean / sd
    t[range(1, d + 1), range(1, d + 1)] = 1 / sd
    return t.T @ (gram * (n / gram[0, 0])) @ t, mean, sd


def fitted(gram: np.ndarray, plain: np.ndarray, alphas: tuple[float, ...]) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) for numbers as they are, of ridge on standardised ones, for every alpha."""
    standard, mean, sd = scaled(gram, plain)
    return [(c / sd, float(b - (c * mean / sd).sum())) for c, b in ridge(standard, alphas)]


def fold_model(parts: dict[int, np.ndarray], plain: dict[int, np.ndarray], alphas: tuple[float, ...]) -> tuple[float, list[float], float]:
    """(alpha, coefficients, intercept) from the training sums of each inner part, with and without weights.

    The alpha is that with the least squared error over the inner parts, each
    predicted by a model of the others that is standardised by the others alone.
    """
    total, rows, error = sum(parts.values()), sum(plain.values()), np.zeros(len(alphas))
    for p in parts:
        if len(parts) > 1:
            error += [squared_error(plain[p], c, b) for c, b in fitted(total - parts[p], rows - plain[p], alphas)]
    alpha = alphas[int(np.argmin(error))]
    coef, intercept = fitted(total, rows, (alpha,))[0]
    return alpha, coef.tolist(), intercept


def cv_models(df: DataFrame, x: str, y: str, fold: str, inner: str, k: int, inner_k: int, alphas: tuple[float, ...], w: str | None, augmented: DataFrame | None, by: str | None = None) -> list[tuple]:
    """``(by, fold, alpha, coefficients, intercept)`` of every fold, from one pass over the rows whatever the number of folds and values of ``by``."""
    cells = k * inner_k
    cell = F.col(fold) * inner_k + F.col(inner) + (F.col(by) * cells if by else F.lit(0))
    sources = [d.withColumn("__k", cell) for d in (df, augmented) if d is not None]
    weighted = [grams(d, x, y, "__k", w) for d in sources]
    plain = [grams(d, x, y, "__k") for d in sources] if w else weighted
    out = []
    for v in sorted({key // cells for g in weighted for key in g}):
        for f in range(k):
            parts, rows = {}, {}
            for sums, got in ((weighted, parts), (plain, rows)):
                for source in sums:
                    for key, g in source.items():
                        if key // cells == v and key % cells // inner_k != f:
                            got[key % inner_k] = got.get(key % inner_k, 0) + g
            if parts:
                out.append((v, f, *fold_model(parts, rows, alphas)))
    return out


def cv_ridge(
    df: DataFrame, ident: str, x: str, y: str, fold: str, inner: str, k: int, inner_k: int = 3, alphas: tuple[float, ...] = ALPHAS, w: str | None = None, augmented: DataFrame | None = None, by: str | None = None,
) -> tuple[DataFrame, dict]:
    """Out-of-fold predictions ``id, fold, y, pred`` and the alpha of each fold, from one pass for sums and one to predict.

    ``augmented`` rows (same columns) join the training side only: those whose
    source is in the fold stay out of it, as they carry the source's fold. With
    ``by`` (a small integer column, returned too) there is a model for each of
    its values, all from the same pass.
    """
    models = cv_models(df, x, y, fold, inner, k, inner_k, alphas, w, augmented, by)
    table = df.sparkSession.createDataFrame([(v, f, c, b) for v, f, _, c, b in models], "__v int, __m int, coef array<double>, b double")
    pred = F.aggregate(F.zip_with(F.col(x).cast("array<double>"), "coef", lambda a, c: a * c), F.col("b"), lambda s, v: s + v)
    at = (F.col(fold) == F.col("__m")) & ((F.col(by) if by else F.lit(0)) == F.col("__v"))
    # a row for each fold and value of ``by``
    out = df.join(F.broadcast(table), at).select(ident, *([by] if by else []), F.col(fold).alias("fold"), F.col(y).alias("y"), pred.alias("pred"))
    return out, {(v, f) if by else f: alpha for v, f, alpha, _, _ in models}


@dataclass
class Repeated:
    """What repeated cross-validation returns; ``per_seed`` arrays are in the order of the columns of folds."""

    rows: DataFrame  # id, y, oof, per_seed, insample
    short: DataFrame | None  # id, y, oof_short, per_seed: means over each row's short versions, null without any
    test: DataFrame | None  # id, pred
    alphas: list[dict[int, float]]


def repeated_cv(
    df: DataFrame, ident: str, x: str, y: str, folds: list[str], inner: str, k: int, inner_k: int = 3, alphas: tuple[float, ...] = ALPHAS, w: str | None = None,
    augmented: DataFrame | None = None, short: DataFrame | None = None, source: str = "source", test: DataFrame | None = None,
) -> Repeated:
    """Cross-validated ridge over several columns of folds, with all that one run of it tells.

    Each row is predicted by the models that were fitted without its fold, one for
    each column, and their mean; ``insample`` is the mean of all models, most of
    which have seen the row. ``short`` holds other versions of rows (``source``, x),
    predicted by the models that have not seen their source, and ``test`` rows that
    no model has seen, predicted by all. ``augmented`` rows (the columns of ``df``,
    with their source's folds) join the training side only. All models of a table
    are applied in one pass; a model is as many numbers as there are features.
    """
    fits = [{f: (alpha, c, b) for _, f, alpha, c, b in cv_models(df, x, y, fold, inner, k, inner_k, alphas, w, augmented)} for fold in folds]
    flat = [np.append(fit[f][1], fit[f][2]) for fit in fits for f in sorted(fit)]
    place = [{f: sum(len(p) for p in fits[:s]) + i for i, f in enumerate(sorted(fit))} for s, fit in enumerate(fits)]
    lines = np.array(flat) if flat else np.zeros((0, 1))

    def apply(batches):
        for b in batches:
            if not b.num_rows:
                continue
            every = matrix(b.column(2)) @ lines[:, :-1].T + lines[:, -1]
            own = []
            for s, at in enumerate(place):
                folds_, back = np.unique(b.column(3 + s).to_numpy(zero_copy_only=False), return_inverse=True)
                own.append(np.array([at.get(f, -1) for f in folds_.tolist()])[back])
            seeds = np.column_stack([np.where(o >= 0, every[np.arange(len(o)), o], np.nan) for o in own])
            listed = pa.ListArray.from_arrays(np.arange(0, seeds.size + 1, seeds.shape[1], dtype=np.int32), pa.array(seeds.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), listed, pa.array(every.mean(1))], names=["id", "y", "per_seed", "all"])

    def predicted(rows: DataFrame, key: str) -> DataFrame:
        got = rows.select(F.col(key).alias("id"), F.col(y).cast("double").alias("y"), F.col(x).cast("array<double>").alias("x"), *[F.col(f).cast("int").alias(f"f{s}") for s, f in enumerate(folds)])
        return got.mapInArrow(apply, f"id {dict(got.dtypes)['id']}, y double, per_seed array<double>, all double")

    mean = F.aggregate("per_seed", F.lit(0.0), lambda a, v: a + v) / len(folds)
    rows = predicted(df, ident).select("id", "y", mean.alias("oof"), "per_seed", F.col("all").alias("insample"))
    crops = None
    if short is not None:
        known = df.select(F.col(ident).alias(source), y, *folds)
        each = predicted(short.select(source, x).join(known, source), source).groupBy("id").agg(F.array(*[F.avg(F.get("per_seed", F.lit(s))) for s in range(len(folds))]).alias("per_seed"))
        crops = df.select(F.col(ident).alias("id"), F.col(y).cast("double").alias("y")).join(each, "id", "left").select("id", "y", mean.alias("oof_short"), "per_seed")
    unseen = None
    if test is not None:
        blank = test.select(ident, x).withColumn(y, F.lit(None).cast("double")).withColumns({f: F.lit(-1) for f in folds})
        unseen = predicted(blank, ident).select("id", F.col("all").alias("pred"))
    return Repeated(rows, crops, unseen, [{f: m[0] for f, m in fit.items()} for fit in fits])


def summary(cv: Repeated, seeds: int) -> DataFrame:
    """One row: composites of the mean prediction, in sample and on short versions, and how much seeds differ (population deviation)."""
    from gradeworks.functions import metrics as M

    score = lambda p: M.composite(M.rmse(F.col("y"), p), M.pearson(F.col("y"), p))
    each = [score(F.get("per_seed", F.lit(s))).alias(f"s{s}") for s in range(seeds)]
    out = cv.rows.agg(F.count("*").alias("n"), score(F.col("oof")).alias("composite"), score(F.col("insample")).alias("composite_insample"), *each)
    spread = F.array(*[f"s{s}" for s in range(seeds)])
    centre = F.aggregate(spread, F.lit(0.0), lambda a, v: a + v) / seeds
    sd = F.sqrt(F.aggregate(F.transform(spread, lambda v: (v - centre) * (v - centre)), F.lit(0.0), lambda a, v: a + v) / seeds)
    out = out.select("n", "composite", "composite_insample", sd.alias("sd_over_seeds"))
    if cv.short is None:
        return out
    return out.crossJoin(cv.short.where("oof_short is not null").agg(F.count("*").alias("n_short"), score(F.col("oof_short")).alias("composite_short")))  # one row each


def layer_profile(df: DataFrame, ident: str, layer: str, x: str, y: str, fold: str, inner: str, k: int) -> DataFrame:
    """``layer, n, rmse, pearson, composite`` of out-of-fold ridge on each layer, all layers in the same two passes."""
    from gradeworks.functions.metrics import report

    oof, _ = cv_ridge(df, ident, x, y, fold, inner, k, by=layer)
    return report(oof, [layer], "y", "pred").select(F.col(layer).alias("layer"), "n", "rmse", "pearson", "composite")


def fourier_features(df: DataFrame, x: str, names: int, features: int = 64, gamma: float = 0.1, seed: int = 0, name: str = "phi") -> DataFrame:
    """``name``: cosines whose products approach the kernel ``exp(-gamma |a - b|^2)`` of the standardised ``names`` numbers in ``x``.

    Directions and phases are drawn once from a seed; the more features, the
    nearer the kernel (the error falls with the square root of their number).
    """
    gram = grams(df.withColumns({"__y": F.lit(0.0), "__k": F.lit(0)}), x, "__y", "__k")
    if not gram:
        return df.withColumn(name, F.array().cast("array<double>"))
    _, mean, sd = scaled(gram[0])
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(features, names)) * np.sqrt(2 * gamma) / sd
    phase = rng.uniform(0, 2 * np.pi, features) - turn @ mean
    listed_names, place = [*df.columns, name], df.columns.index(x)

    def work(batches):
        for b in batches:
            phi = np.cos(matrix(b.column(place))[:, :names] @ turn.T + phase) * np.sqrt(2 / features) if b.num_rows else np.zeros((0, features))
            listed = pa.ListArray.from_arrays(np.arange(0, phi.size + 1, features, dtype=np.int32), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, listed], names=listed_names)

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def kernel_ridge(df: DataFrame, ident: str, x: str, names: int, y: str, fold: str, inner: str, k: int, features: int = 64, gamma: float = 0.1, alphas: tuple[float, ...] = KERNEL_ALPHAS) -> DataFrame:
    """Out-of-fold RBF kernel ridge for any number of rows: ridge on Fourier features, every row fitted and predicted."""
    rows = df.select(*dict.fromkeys((ident, x, y, fold, inner)))
    return cv_ridge(fourier_features(rows, x, names, features, gamma), ident, "phi", y, fold, inner, k, alphas=alphas)[0]


#: Distinct rows that a task keeps for trees, and settings under which equal rows can stand for one another by their mean and count.
TREE_ROWS, MEAN_WILL_DO = 250_000, {"maxIter", "maxDepth", "maxBins", "stepSize", "minInfoGain", "seed"}


def tree_rows(df: DataFrame, features: list[str], y: str, fold: str, params: dict) -> DataFrame:
    """What trees are fitted on, in tasks of a bounded number of rows: squared errors split rows of equal features and fold as their mean with their count does."""
    columns = [*features, F.col(y).cast("double").alias("__y"), F.col(fold).alias("__fold")]
    rows = df.select(*columns, F.lit(1.0).alias("__n"))
    if set(params) <= MEAN_WILL_DO:
        # a missing target stays missing, which the trees refuse
        mean = F.when(F.count("__y") == F.count("*"), F.avg("__y"))
        rows = rows.groupBy(*features, "__fold").agg(mean.alias("__y"), F.count("*").cast("double").alias("__n"))
    rows = written(rows, "tree-rows")
    return rows.repartition(max(1, -(-rows.count() // TREE_ROWS)), *features, "__fold")


def boosted_trees(df: DataFrame, features: list[str], y: str, fold: str, k: int, **params) -> DataFrame:
    """Out-of-fold boosted trees by the ML library; its trees are built over the cluster."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="__x")
    rows, fitted, out = assembler.transform(df), assembler.transform(tree_rows(df, features, y, fold, params)), None
    for f in range(k):
        model = GBTRegressor(featuresCol="__x", labelCol="__y", weightCol="__n", predictionCol="pred", seed=0, **({"maxIter": 10, "maxDepth": 3} | params)).fit(fitted.where(F.col("__fold") != f))
        one = model.transform(rows.where(F.col(fold) == f)).drop("__x")
        out = one if out is None else out.unionByName(one)
    return out

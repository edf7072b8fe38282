"""Queries for heads, stacking, calibration, smoothing, blends and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gradeworks.functions import metrics
from gradeworks.functions import scalars as S
from gradeworks.operators import blending, heads, kernels, resampling, stacking
from gradeworks.plans.registry import query
from gradeworks.plans.relational import PREDICTED, RMSE, RP, predicted, r6
from gradeworks.sources.tables import table

#: Two weak models of a line's price, in thousands: by quantity and part price, and by quantity alone.
MODELS = """(SELECT l_orderkey, l_linenumber, (l_orderkey % 5)::int AS fold, (l_suppkey % 4)::int AS pop, l_suppkey, l_extendedprice / 1000 AS y, l_quantity * p_retailprice / 1000 AS p1, l_quantity AS p2
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def models(spark, sf_dir):
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.join(part, li.l_partkey == part.p_partkey)
    return rows.select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 5).cast("int").alias("fold"), (F.col("l_suppkey") % 4).cast("int").alias("pop"), "l_suppkey",
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("p1"), F.col("l_quantity").alias("p2"),
    )


def design(spark, sf_dir):
    """Features of a line, its truth, outer fold by order and inner fold by supplier."""
    x = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")])
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.monotonically_increasing_id().alias("row"), "l_orderkey", "l_linenumber", x.alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), (F.col("l_suppkey") % 3).cast("int").alias("inner"),
        F.col("l_quantity").alias("w"),
    )


@query("r1_ridge_one_feature", "SELECT a::double AS alpha, round((sum(l_quantity * (l_extendedprice / 1000)) - count(*) * avg(l_quantity) * avg(l_extendedprice / 1000)) / (count(*) * var_pop(l_quantity) + a), 6) AS coef FROM lineitem, (VALUES (1.0), (100.0), (10000.0)) t(a) GROUP BY a")
def r1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double")).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.lit(0).alias("k"))
    alphas = (1.0, 100.0, 10000.0)
    path = heads.ridge(heads.grams(rows, "x", "y", "k")[0], alphas)
    return spark.createDataFrame([(a, round(float(c[0]), 6)) for a, (c, _) in zip(alphas, path, strict=True)], "alpha double, coef double")


# Two features have a closed form, so SQL can follow the folds, the inner folds and every alpha.

SUMS = ("n", "s1", "s2", "sy", "s11", "s12", "s22", "s1y", "s2y", "syy")
ADDED = ", ".join(f"sum({m}) AS {m}" for m in SUMS)
LESS = ", ".join(f"t.{m} - p.{m} AS {m}" for m in SUMS)


def moments_sql(x1: str, x2: str, y: str, w: str = "1.0") -> str:
    """The sums of two features, the truth and their products."""
    parts = ("1", x1, x2, y, f"{x1} * {x1}", f"{x1} * {x2}", f"{x2} * {x2}", f"{x1} * {y}", f"{x2} * {y}", f"{y} * {y}")
    return ", ".join(f"sum(({w}) * ({part})) AS {name}" for name, part in zip(SUMS, parts, strict=True))


#: Coefficients ``k1, k2`` and intercept ``b0`` of ridge with penalty ``a`` on features that are divided by ``d1, d2``, from the sums of a row.
SOLVED = """SELECT *, sy / n - k1 * s1 / n - k2 * s2 / n AS b0 FROM (SELECT *, (c * u - b * v) / (p * c - b * b) / d1 AS k1, (p * v - b * u) / (p * c - b * b) / d2 AS k2
 FROM (SELECT *, (s11 - s1 * s1 / n) / (d1 * d1) + a AS p, (s12 - s1 * s2 / n) / (d1 * d2) AS b, (s22 - s2 * s2 / n) / (d2 * d2) + a AS c, (s1y - s1 * sy / n) / d1 AS u, (s2y - s2 * sy / n) / d2 AS v FROM ({})))"""
DEVIATIONS = "sqrt(greatest(s11 / n - (s1 / n) ** 2, 0)) + 1e-6 AS d1, sqrt(greatest(s22 / n - (s2 / n) ** 2, 0)) + 1e-6 AS d2"
GRID = "(SELECT 10 ** (i / 4.0 - 1) AS a FROM range(0, 25) r(i))"
X1, X2, Y = "l_quantity", "l_linenumber", "l_extendedprice / 1000"
NOISE = [f"0.05 * {{u}}".replace("{u}", "(((((12345 * 7919 + l_orderkey * 104729 + 17) % 1000003) * 7919 + (l_linenumber + {i}) * 104729 + 17) % 1000003) / 1000003.0)".format(i=i)) for i in (0, 1)]


def cv_sql(augmented: bool) -> str:
    """Tables ``chosen`` (fold and alpha) and ``model`` (fold, k1, k2, b0) of cross-validated ridge."""
    own = f"SELECT (l_orderkey % 5)::int AS fold, (l_suppkey % 3)::int AS part, {moments_sql(X1, X2, Y)} FROM lineitem GROUP BY 1, 2"
    more = f" UNION ALL SELECT (l_orderkey % 5)::int, (l_suppkey % 3)::int, {moments_sql(f'({X1} + {NOISE[0]})', f'({X2} + {NOISE[1]})', Y)} FROM lineitem GROUP BY 1, 2" if augmented else ""
    return f"""cells AS ({own}{more}), f AS (SELECT k::int AS f FROM range(0, 5) r(k)),
    parts AS (SELECT f, part, {ADDED} FROM cells, f WHERE fold <> f GROUP BY 1, 2), total AS (SELECT f, {ADDED} FROM parts GROUP BY 1), dev AS (SELECT f, {DEVIATIONS} FROM total),
    inner_fit AS ({SOLVED.format(f"SELECT *, {DEVIATIONS} FROM (SELECT t.f, p.part, {LESS} FROM total t JOIN parts p ON t.f = p.f), {GRID}")}),
    loss AS (SELECT i.f, i.a, sum(p.syy - 2 * (k1 * p.s1y + k2 * p.s2y + b0 * p.sy) + k1 * k1 * p.s11 + 2 * k1 * k2 * p.s12 + k2 * k2 * p.s22 + 2 * b0 * (k1 * p.s1 + k2 * p.s2) + b0 * b0 * p.n) AS e
      FROM inner_fit i JOIN parts p ON i.f = p.f AND i.part = p.part GROUP BY 1, 2),
    chosen AS (SELECT f AS fold, a FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY e, a) AS r FROM loss) WHERE r = 1),
    model AS ({SOLVED.format("SELECT t.*, d1, d2, a FROM total t JOIN dev ON dev.f = t.f JOIN chosen ON chosen.fold = t.f")})"""


def oof_sql(augmented: bool) -> str:
    return f"""WITH {cv_sql(augmented)}, o AS (SELECT f AS fold, {Y} AS y, b0 + k1 * {X1} + k2 * {X2} AS p FROM lineitem JOIN model ON l_orderkey % 5 = f),
    m AS (SELECT fold, count(*) AS n, sqrt(avg((y - p) ** 2)) AS rmse, covar_pop(y, p) / sqrt(var_pop(y) * var_pop(p)) AS pearson FROM o GROUP BY 1)
    SELECT fold, n, round(rmse, 4) AS rmse, round(pearson, 4) AS pearson, round(0.6 * rmse + 0.4 * (1 - pearson), 4) AS composite FROM m"""


def two(spark, sf_dir):
    return design(spark, sf_dir).withColumn("x", F.array(F.get("x", F.lit(0)), F.get("x", F.lit(3))))


@query(
    "r1_ridge_path",
    f"""WITH w AS (SELECT {moments_sql(X1, X2, Y, 'l_quantity')} FROM lineitem), u AS (SELECT n AS rows, {DEVIATIONS} FROM (SELECT {moments_sql(X1, X2, Y)} FROM lineitem)),
    t AS (SELECT {', '.join(f'{m} * rows / n AS {m}' for m in SUMS)}, d1, d2 FROM w, u)
    SELECT round(a, 6) AS alpha, round(k1, 6) AS first, round(k2, 6) AS second, round(b0, 6) AS intercept FROM ({SOLVED.format(f'SELECT * FROM t, {GRID}')})""",
)
def r1p(spark, sf_dir):
    rows = two(spark, sf_dir)
    gram, plain = (sum(heads.grams(rows, "x", "y", "fold", w).values()) for w in ("w", None))
    path = zip(heads.ALPHAS, heads.fitted(gram, plain, heads.ALPHAS), strict=True)
    return spark.createDataFrame([(round(a, 6), *[round(float(v), 6) for v in c], round(b, 6)) for a, (c, b) in path], "alpha double, first double, second double, intercept double")


@query("r2_inner_alpha", f"WITH {cv_sql(False)} SELECT fold, round(a, 6) AS alpha FROM chosen")
def r2(spark, sf_dir):
    _, picked = heads.cv_ridge(two(spark, sf_dir), "l_orderkey", "x", "y", "fold", "inner", 5)
    return spark.createDataFrame([(f, round(a, 6)) for f, a in sorted(picked.items())], "fold int, alpha double")


@query("r3_grouped_cv_ridge", oof_sql(False))
def r3(spark, sf_dir):
    oof, _ = heads.cv_ridge(two(spark, sf_dir), "l_orderkey", "x", "y", "fold", "inner", 5)
    return metrics.report(oof, ["fold"], "y", "pred").select("fold", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "pearson", "composite")])


@query("r3_augmented_cv_ridge", oof_sql(True))
def r3a(spark, sf_dir):
    rows = two(spark, sf_dir)
    noisy = rows.withColumn("x", F.transform("x", lambda v, i: v + 0.05 * S.hashed_unit(F.col("l_orderkey"), F.col("l_linenumber") + i)))
    oof, _ = heads.cv_ridge(rows, "l_orderkey", "x", "y", "fold", "inner", 5, augmented=noisy)
    return metrics.report(oof, ["fold"], "y", "pred").select("fold", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "pearson", "composite")])


@query("r3_repeated_cv")
def r3r(spark, sf_dir):
    """Folds by order and by part; a line without its tax is its short version."""
    rows = design(spark, sf_dir).withColumns({"key": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "fold2": F.pmod(F.xxhash64("l_orderkey"), F.lit(5)).cast("int")})
    short = rows.select(F.col("key").alias("source"), F.transform("x", lambda v, i: F.when(i == 2, 0.0).otherwise(v)).alias("x"))
    cv = heads.repeated_cv(rows, "key", "x", "y", ["fold", "fold2"], "inner", 5, w="w", short=short)
    out = heads.summary(cv, 2)
    return out.select("n", "n_short", *[F.round(c, 4).alias(c) for c in ("composite", "composite_insample", "composite_short", "sd_over_seeds")])


@query("r4_kernel_ridge_cv")
def r4(spark, sf_dir):
    out = heads.kernel_ridge(design(spark, sf_dir), "l_orderkey", "x", 4, "y", "fold", "inner", 5)
    return metrics.report(out, ["fold"], "y", "pred").select("fold", "n", F.round("rmse", 3).alias("rmse"))


@query("r4_support_vectors_cv")
def r4s(spark, sf_dir):
    rows = design(spark, sf_dir).withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out, _ = kernels.support_vectors(rows, "key", "x", "y", "fold", "inner", 5, landmarks=64)
    return metrics.report(out, ["fold"], "y", "pred").select("fold", "n", F.round("rmse", 1).alias("rmse"))


@query("r4_boosted_trees_cv")
def r4b(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_orderkey") % 3).cast("int").alias("fold"))
    out = heads.boosted_trees(rows, ["l_quantity", "l_discount", "l_tax"], "y", "fold", 3)
    return metrics.report(out, ["fold"], "y", "pred").select("fold", "n", F.round("rmse", 2).alias("rmse"))


def model_grams(spark, sf_dir):
    return heads.grams(models(spark, sf_dir).withColumn("x", F.array("p1", "p2")), "x", "y", "fold")


#: Two non-negative weights have a closed form: both, or the better one alone.
NNLS = """SELECT *, sy / n - w1 * s1 / n - w2 * s2 / n AS b0 FROM (SELECT *, CASE WHEN e1 >= 0 AND e2 >= 0 THEN e1 WHEN g1 >= g2 THEN greatest(u / p, 0) ELSE 0 END AS w1, CASE WHEN e1 >= 0 AND e2 >= 0 THEN e2 WHEN g1 >= g2 THEN 0 ELSE greatest(v / c, 0) END AS w2
 FROM (SELECT *, (c * u - b * v) / (p * c - b * b) AS e1, (p * v - b * u) / (p * c - b * b) AS e2, CASE WHEN u > 0 THEN u * u / p ELSE 0 END AS g1, CASE WHEN v > 0 THEN v * v / c ELSE 0 END AS g2
 FROM (SELECT *, s11 - s1 * s1 / n AS p, s12 - s1 * s2 / n AS b, s22 - s2 * s2 / n AS c, s1y - s1 * sy / n AS u, s2y - s2 * sy / n AS v FROM ({}))))"""
STACK = f"(SELECT {moments_sql('p1', 'p2', 'y')} FROM {MODELS})"


@query("k1_nnls", f"WITH s AS ({NNLS.format('SELECT * FROM ' + STACK)}) SELECT 'p1' AS name, round(w1, 6) AS weight FROM s UNION ALL SELECT 'p2', round(w2, 6) FROM s UNION ALL SELECT 'intercept', round(b0, 6) FROM s")
def k1(spark, sf_dir):
    coef, b = stacking.nnls(sum(model_grams(spark, sf_dir).values()))
    return spark.createDataFrame([("p1", round(float(coef[0]), 6)), ("p2", round(float(coef[1]), 6)), ("intercept", round(b, 6))], "name string, weight double")


CAL = f"""s AS (SELECT pop, count(*) AS n, sum(p1) AS x, sum(y) AS y, sum(p1 * p1) AS xx, sum(p1 * y) AS xy FROM {MODELS} GROUP BY 1), b AS (SELECT sum(xy - x * y / n) / sum(xx - x * x / n) AS b FROM s)"""


@query("k2_calibration_fit", f"WITH {CAL} SELECT pop, round(y / n - b * x / n, 6) AS a, round(b, 6) AS b FROM s, b")
def k2(spark, sf_dir):
    return stacking.calibration(models(spark, sf_dir), "pop", "p1", "y").select("pop", r6("a").alias("a"), r6("b").alias("b"))


@query("k3_calibration_apply", f"WITH {CAL} SELECT m.pop, round(avg(b * p1 + s.y / n - b * x / n), 6) AS mean_pred, round(max(b * p1 + s.y / n - b * x / n), 6) AS top FROM {MODELS} m JOIN s USING (pop), b GROUP BY 1")
def k3(spark, sf_dir):
    rows = models(spark, sf_dir)
    out = stacking.calibrated(rows, stacking.calibration(rows, "pop", "p1", "y"), "pop", "p1")
    return out.groupBy("pop").agg(r6(F.avg("pred")).alias("mean_pred"), r6(F.max("pred")).alias("top"))


@query("k4_least_squares_line", f"SELECT round(regr_intercept(y, p2), 6) AS a, round(regr_slope(y, p2), 6) AS b FROM {MODELS}")
def k4(spark, sf_dir):
    return stacking.line(models(spark, sf_dir), "p2", "y").select(r6("a").alias("a"), r6("b").alias("b"))


NESTED = f"""g AS (SELECT fold, {moments_sql('p1', 'p2', 'y')} FROM {MODELS} GROUP BY 1), t AS (SELECT f.fold, {', '.join(f'sum(o.{m}) AS {m}' for m in SUMS)} FROM g f JOIN g o ON o.fold <> f.fold GROUP BY 1),
 w AS ({NNLS.format('SELECT * FROM t')}), q AS (SELECT m.fold, y, greatest(1.0, least(90.0, b0 + w1 * p1 + w2 * p2)) AS p FROM {MODELS} m JOIN w ON m.fold = w.fold),
 c AS (SELECT 0.6 * sqrt(avg((y - p) ** 2)) + 0.4 * (1 - CASE WHEN var_pop(p) > 1e-9 THEN covar_pop(y, p) / sqrt(var_pop(y) * var_pop(p)) ELSE 0 END) AS composite FROM q)"""
BOUNDS = (1.0, 90.0)


@query("k5_nested_stack", f"WITH {NESTED} SELECT fold, round(w1, 6) AS w1, round(w2, 6) AS w2, round(b0, 6) AS intercept, round(composite, 6) AS composite FROM w, c")
def k5(spark, sf_dir):
    score, _, fits = stacking.nested(models(spark, sf_dir).withColumn("x", F.array("p1", "p2")), "x", "y", ["fold"], bounds=BOUNDS)
    rows = [(f, *[round(float(c), 6) for c in m.coef], round(m.intercept, 6), round(score, 6)) for f, m in sorted(fits[0].items())]
    return spark.createDataFrame(rows, "fold int, w1 double, w2 double, intercept double, composite double")


@query("k5_population_stack")
def k5p(spark, sf_dir):
    """The nested stack over two columns of folds, with an intercept for each population, fitted with one set of row weights and judged with another."""
    rows = models(spark, sf_dir).withColumns({"x": F.array("p1", "p2"), "fold2": (F.col("l_suppkey") % 3).cast("int"), "w": F.when(F.col("pop") == 0, 2.0).otherwise(1.0)})
    score, each, _ = stacking.nested(rows, "x", "y", ["fold", "fold2"], "pop", w_judge="w", bounds=BOUNDS)
    return spark.createDataFrame([(name, round(v, 6)) for name, v in zip(("mean", "fold", "fold2"), (score, *each), strict=True)], "folds string, composite double")


@query("k6_final_stack", f"WITH s AS ({NNLS.format('SELECT * FROM ' + STACK)}) SELECT count(*) AS n, round(min(p), 4) AS low, round(max(p), 4) AS high, round(avg(p), 4) AS mean FROM (SELECT greatest(1.0, least(90.0, b0 + w1 * p1 + w2 * p2)) AS p FROM {MODELS}, s)")
def k6(spark, sf_dir):
    coef, b = stacking.nnls(sum(model_grams(spark, sf_dir).values()))
    out = stacking.stacked(models(spark, sf_dir).withColumn("p", F.array("p1", "p2")), "p", coef, b, 1.0, 90.0)
    return out.agg(F.count("*").alias("n"), *[F.round(f("pred"), 4).alias(c) for f, c in ((F.min, "low"), (F.max, "high"), (F.avg, "mean"))])


@query("k7_greedy_pruning")
def k7(spark, sf_dir):
    """Each step of the pruning: the models that are left, and their composite."""
    rows = models(spark, sf_dir).withColumn("noise", S.hashed_unit(F.col("l_orderkey"), F.col("l_linenumber")))
    way = stacking.pruned(rows.withColumn("x", F.array("p1", "p2", "noise")), "x", "y", ["fold"], bounds=BOUNDS)
    return spark.createDataFrame([(i, [["p1", "p2", "noise"][k] for k in kept], score) for i, (kept, score) in enumerate(way)], "step int, kept array<string>, composite double")


@query("k8_cluster_smoothing", f"SELECT l_orderkey, l_linenumber, round(0.7 * p1 + 0.3 * avg(p1) OVER (PARTITION BY l_suppkey), 9) AS smooth FROM {MODELS}")
def k8(spark, sf_dir):
    return stacking.smoothed(models(spark, sf_dir), "l_suppkey", "p1", 0.3).select("l_orderkey", "l_linenumber", F.round("smooth", 9).alias("smooth"))


@query(
    "k9_smoothing_grid",
    f"""SELECT l AS strength, round(0.6 * {RMSE} + 0.4 * (1 - {RP}), 6) AS composite FROM (SELECT y, l, (1 - l) * p1 + l * m AS p FROM (SELECT *, avg(p1) OVER (PARTITION BY l_suppkey) AS m FROM {MODELS}), (SELECT k / 10.0 AS l FROM range(0, 11) r(k))) GROUP BY 1""",
)
def k9(spark, sf_dir):
    return stacking.smoothing_grid(models(spark, sf_dir), "l_suppkey", "p1", "y").select("strength", r6("composite").alias("composite"))


@query("k12_finalise", f"SELECT l_orderkey, l_linenumber, CASE WHEN p2 < 8 THEN 0.0 ELSE round(greatest(1.0, least(60.0, 0.6 * p1 + 0.4 * avg(p1) OVER (PARTITION BY l_suppkey))), 9) END AS label FROM {MODELS}")
def k12(spark, sf_dir):
    strength = min(max(0.7, 0.2), 0.4)
    out = stacking.smoothed(models(spark, sf_dir), "l_suppkey", "p1", strength)
    return out.select("l_orderkey", "l_linenumber", F.when(F.col("p2") < 8, 0.0).otherwise(F.round(S.clip(F.col("smooth"), 1.0, 60.0), 9)).alias("label"))


# scores from moments

MOMENTS = f"(SELECT p_brand, avg(y) AS my, stddev_pop(y) AS sy, avg(p) AS mp, stddev_pop(p) AS sp, covar_pop(y, p) AS c FROM (SELECT p_brand, y / 1000 AS y, p / 1000 AS p FROM {PREDICTED}) GROUP BY 1)"
ERROR = "sqrt(greatest(sy * sy + sp * sp - 2 * c + (mp - my) * (mp - my), 0.0))"


def moments(spark, sf_dir):
    rows = predicted(spark, sf_dir).select("p_brand", (F.col("y") / 1000).alias("y"), (F.col("p") / 1000).alias("p"))
    m = rows.groupBy("p_brand").agg(F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"), F.avg("p").alias("mp"), F.stddev_pop("p").alias("sp"), F.covar_pop("y", "p").alias("c"))
    error = blending.error_from_moments(F.col("sy"), F.col("my"), F.col("sp"), F.col("mp"), F.col("c"))
    return m.withColumn("rmse", error).withColumn("score", blending.predicted(F.col("rmse"), F.col("c"), F.col("sy"), F.col("sp")))


query("l1_rmse_from_moments", f"SELECT p_brand, round({ERROR}, 6) AS rmse FROM {MOMENTS}")(lambda s, d: moments(s, d).select("p_brand", r6("rmse").alias("rmse")))
query("l2_predicted_score", f"SELECT p_brand, round(0.6 * {ERROR} + 0.4 * (1 - c / (sy * sp)), 6) AS score FROM {MOMENTS}")(lambda s, d: moments(s, d).select("p_brand", r6("score").alias("score")))


@query("l3_implied_correlation", f"SELECT p_brand, round(c / (sy * sp), 6) AS r FROM {MOMENTS}")
def l3(spark, sf_dir):
    r = blending.implied_correlation(F.col("score"), F.col("sy"), F.col("my"), F.col("sp"), F.col("mp"))
    return moments(spark, sf_dir).select("p_brand", r6(r).alias("r"))


@query("l4_convex_blend")
def l4(spark, sf_dir):
    w, a, b, score = blending.convex_blend(sum(model_grams(spark, sf_dir).values()))
    return spark.createDataFrame([([float(v) for v in w], float(a), float(b), float(score))], "weights array<double>, a double, b double, composite double")


@query("l5_metric_identification")
def l5(spark, sf_dir):
    m = models(spark, sf_dir).agg(F.var_pop("p1"), F.stddev_pop("y"), F.corr("p1", "y"), F.avg(F.col("p1") - F.col("y"))).first()
    scale = m[1]
    var_p, sd, r, bias = m[0] / scale**2, 1.0, m[2], m[3] / scale
    cov = r * sd * var_p**0.5
    base = sd * sd + var_p - 2 * cov + bias * bias
    errors = np.sqrt([base, base - bias + 0.25, base - 2 * bias + 1, base - 3 * bias + 2.25, base - 0.75 * var_p + cov])
    return spark.createDataFrame([(n, float(x)) for n, x in blending.identify(0.6 * errors + 0.4 * (1 - r), var_p)], "formula string, misfit double")


#: Both halves of a hashed number: of a row and of a resample or draw.
FIRST = "((12345 * 7919 + {} * 104729 + 17) % 1000003 * 7919 % 1000003)"
SECOND = "((r * 104729 + 17) % 1000003)"
SCORED = lambda p: f"0.6 * sqrt(avg((y - {p}) ** 2)) + 0.4 * (1 - covar_pop(y, {p}) / sqrt(var_pop(y) * var_pop({p})))"
DRAWS, SHARE, RESAMPLES = 300, 0.6, 2000


@query(
    "l6_split_simulation",
    f"""WITH m AS (SELECT {FIRST.format('l_orderkey')} AS a, y, p1, p2 FROM {MODELS}), d AS (SELECT r AS draw, {SECOND} AS b FROM range(0, {DRAWS}) t(r)),
    s AS (SELECT draw, ((a + b) % 1000003) / 1000003.0 < {SHARE} AS public, {SCORED('p1')} AS p1, {SCORED('p2')} AS p2 FROM m, d GROUP BY 1, 2),
    t AS (SELECT a.draw, CASE WHEN a.p1 <= a.p2 THEN 'p1' ELSE 'p2' END AS pick, b.p1, b.p2 FROM s a JOIN s b USING (draw) WHERE a.public AND NOT b.public)
    SELECT pick, count(*) AS draws, round(avg(least(p1, p2)), 4) AS best, round(avg(CASE WHEN pick = 'p1' THEN p1 ELSE p2 END), 4) AS got FROM t GROUP BY 1""",
)
def l6(spark, sf_dir):
    """Draws of a part of the rows to choose a model on, and the rest to judge it by."""
    s = resampling.splits(models(spark, sf_dir), "l_orderkey", "y", ["p1", "p2"], DRAWS, SHARE)
    both = s.where("part = 0").select("resample", F.when(F.col("p1") <= F.col("p2"), "p1").otherwise("p2").alias("pick")).join(s.where("part = 1"), "resample")
    return both.groupBy("pick").agg(F.count("*").alias("draws"), F.round(F.avg(F.least("p1", "p2")), 4).alias("best"), F.round(F.avg(F.when(F.col("pick") == "p1", F.col("p1")).otherwise(F.col("p2"))), 4).alias("got"))


# resampling

TIMES = "CASE " + " ".join(f"WHEN u < {p} THEN {k}" for k, p in enumerate(resampling.POISSON)) + f" ELSE {len(resampling.POISSON)} END"
WP = "((sum(w * y * {p}) / sum(w) - sum(w * y) / sum(w) * sum(w * {p}) / sum(w)) / sqrt((sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2) * (sum(w * {p} * {p}) / sum(w) - (sum(w * {p}) / sum(w)) ** 2)))"
BOOT = lambda p: f"0.6 * sqrt(sum(w * (y - {p}) * (y - {p})) / sum(w)) + 0.4 * (1 - {WP.format(p=p)})"
DRAWN = f"(SELECT resample, y, p1, p2, ((a + b) % 1000003) / 1000003.0 AS u FROM (SELECT {FIRST.format('(l_orderkey * 10 + l_linenumber)')} AS a, y, p1, p2 FROM {MODELS}), (SELECT r AS resample, {SECOND} AS b FROM range(0, {RESAMPLES}) t(r)))"
SAMPLED = lambda weight: f"(SELECT resample, {BOOT('p1')} AS p1, {BOOT('p2')} AS p2 FROM (SELECT resample, y, p1, p2, {TIMES} * {weight} AS w FROM {DRAWN}) GROUP BY 1)"
SAMPLES = SAMPLED("1")


def resamples(spark, sf_dir, w=None):
    rows = models(spark, sf_dir).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return resampling.resampled(rows, "id", "y", ["p1", "p2"], RESAMPLES, w)


@query("e5_bootstrap_interval", f"SELECT round(quantile_cont(p1, 0.025), 6) AS low, round(quantile_cont(p1, 0.5), 6) AS mid, round(quantile_cont(p1, 0.975), 6) AS high FROM {SAMPLES}")
def e5(spark, sf_dir):
    return resampling.interval(resamples(spark, sf_dir), "p1").select(*[r6(c).alias(c) for c in ("low", "mid", "high")])


@query("e6_weighted_bootstrap", f"SELECT round(quantile_cont(p1, 0.025), 4) AS low, round(quantile_cont(p1, 0.5), 4) AS mid, round(quantile_cont(p1, 0.975), 4) AS high FROM {SAMPLED('p2')}")
def e6(spark, sf_dir):
    return resampling.interval(resamples(spark, sf_dir, "p2"), "p1").select(*[F.round(c, 4).alias(c) for c in ("low", "mid", "high")])


@query(
    "e7_paired_bootstrap",
    f"SELECT round(avg(p2 - p1), 6) AS delta, round(quantile_cont(p2 - p1, 0.025), 6) AS low, round(quantile_cont(p2 - p1, 0.975), 6) AS high, round(avg((p2 < p1)::int), 6) AS p_better FROM {SAMPLES}",
)
def e7(spark, sf_dir):
    return resampling.paired(resamples(spark, sf_dir), "p1", "p2").select(*[r6(c).alias(c) for c in ("delta", "low", "high", "p_better")])

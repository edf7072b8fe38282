"""Queries over vectors: similarity joins, neighbours, clusters, priors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeworks.functions import vectors as V
from gradeworks.operators import folds, heads, linkage, relations, stacking
from gradeworks.plans.registry import query
from gradeworks.plans.relational import r6
from gradeworks.sources.scratch import written
from gradeworks.sources.tables import table

CUT = 0.3
DOT = "list_inner_product(a.embedding::double[], b.embedding::double[])"
NN = f"(SELECT id, nn, sim FROM (SELECT a.vec_id AS id, b.vec_id AS nn, {DOT} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r = 1)"


def emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query("j8_similarity_join", f"SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {DOT} > {CUT}")
def j8(spark, sf_dir):
    return relations.similar_pairs(emb(spark, sf_dir), "vec_id", "embedding", CUT).select("a", "b", r6("sim").alias("sim"))


@query("j9_nearest_neighbour", f"SELECT id, nn, round(sim, 6) AS sim FROM {NN}")
def j9(spark, sf_dir):
    return relations.nearest(emb(spark, sf_dir), emb(spark, sf_dir), "vec_id", "embedding").select("id", "nn", r6("sim").alias("sim"))


CROSS = f"(SELECT id, nn, sim FROM (SELECT a.vec_id AS id, b.vec_id AS nn, {DOT} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0) WHERE r = 1)"


def cross(spark, sf_dir):
    e = emb(spark, sf_dir)
    return relations.nearest(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), "vec_id", "embedding", exclude_self=False)


@query("j10_nearest_across", f"SELECT id, nn, round(sim, 6) AS sim, label FROM {CROSS} JOIN embeddings ON nn = vec_id")
def j10(spark, sf_dir):
    labels = emb(spark, sf_dir).select(F.col("vec_id").alias("nn"), "label")
    return cross(spark, sf_dir).join(labels, "nn").select("id", "nn", r6("sim").alias("sim"), "label")


CENTER = "c AS (SELECT d, avg(embedding[d]::double) AS m FROM embeddings, range(1, 65) r(d) GROUP BY 1)"


@query(
    "v1_centred_unit",
    f"WITH {CENTER}, x AS (SELECT vec_id, d, embedding[d]::double - m AS x FROM embeddings, c) SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm, round(max(x / n), 6) AS top, round(sum(x / n), 6) AS total FROM x JOIN (SELECT vec_id, sqrt(sum(x * x)) AS n FROM x GROUP BY 1) USING (vec_id) GROUP BY 1",
)
def v1(spark, sf_dir):
    e = emb(spark, sf_dir).select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    center = V.mean_vector(e, "v")
    raw = e.crossJoin(F.broadcast(center)).select("vec_id", V.norm(F.zip_with("v", "center", lambda x, m: x - m)).alias("norm"))
    unit = V.centred_unit(e, "v", center)
    out = unit.select("vec_id", r6(F.array_max("v")).alias("top"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))
    return raw.join(out, "vec_id").select("vec_id", r6("norm").alias("norm"), "top", "total")


@query("v2_dot_product", "SELECT a.vec_id AS id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) AS sim FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def v2(spark, sf_dir):
    probe = emb(spark, sf_dir).where("vec_id = 0").select(F.col("embedding").alias("q"))
    return emb(spark, sf_dir).crossJoin(F.broadcast(probe)).select(F.col("vec_id").alias("id"), r6(V.dot(F.col("embedding"), F.col("q"))).alias("sim"))


def layers(spark, sf_dir):
    """Blocks of four dimensions stand for layers."""
    e = emb(spark, sf_dir).select("vec_id", "label", F.posexplode(V.doubles(F.col("embedding"))).alias("d", "x"))
    return e.select("vec_id", "label", F.floor(F.col("d") / 4).cast("int").alias("layer"), (F.col("d") % 4).alias("dim"), "x")


LAYERS = "(SELECT vec_id, label, ((d - 1) // 4)::int AS layer, ((d - 1) % 4)::int AS dim, embedding[d]::double AS x FROM embeddings, range(1, 65) r(d))"


@query("v3_band_mean", f"SELECT vec_id, dim, round(avg(x), 6) AS m FROM {LAYERS} WHERE layer >= 4 AND layer < 8 GROUP BY 1, 2")
def v3(spark, sf_dir):
    return layers(spark, sf_dir).where("layer >= 4 AND layer < 8").groupBy("vec_id", "dim").agg(r6(F.avg("x")).alias("m"))


@query("v4_standardise", f"SELECT vec_id, layer, dim, round((x - m) / (s + 1e-6), 6) AS z FROM {LAYERS} JOIN (SELECT layer, dim, avg(x) AS m, stddev_pop(x) AS s FROM {LAYERS} WHERE vec_id % 5 <> 0 GROUP BY 1, 2) USING (layer, dim)")
def v4(spark, sf_dir):
    rows = layers(spark, sf_dir)
    stats = rows.where("vec_id % 5 <> 0").groupBy("layer", "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return rows.join(F.broadcast(stats), ["layer", "dim"]).select("vec_id", "layer", "dim", r6((F.col("x") - F.col("m")) / (F.col("s") + 1e-6)).alias("z"))


@query("v5_row_norm", f"SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm, bool_and(isfinite(x)) AS finite FROM {LAYERS} WHERE layer = 15 GROUP BY 1")
def v5(spark, sf_dir):
    finite = ~F.isnan("x") & (F.abs("x") != float("inf"))
    return layers(spark, sf_dir).where("layer = 15").groupBy("vec_id").agg(r6(F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("norm"), F.bool_and(finite).alias("finite"))


@query("v6_mean_std_pooling", f"SELECT vec_id, dim, round(avg(x), 6) AS m, round(stddev_samp(x), 6) AS s FROM {LAYERS} GROUP BY 1, 2")
def v6(spark, sf_dir):
    return layers(spark, sf_dir).groupBy("vec_id", "dim").agg(r6(F.avg("x")).alias("m"), r6(F.stddev_samp("x")).alias("s"))


@query("v7_masked_pooling", f"SELECT vec_id, dim, round(avg(x), 6) AS m, round(sqrt(greatest(var_pop(x), 1e-6)), 6) AS s FROM {LAYERS} WHERE layer < 4 + vec_id % 12 GROUP BY 1, 2")
def v7(spark, sf_dir):
    kept = layers(spark, sf_dir).where("layer < 4 + vec_id % 12")
    return kept.groupBy("vec_id", "dim").agg(r6(F.avg("x")).alias("m"), r6(F.sqrt(F.greatest(F.var_pop("x"), F.lit(1e-6)))).alias("s"))


ENERGY = f"(SELECT vec_id, layer, 20 * log10(sqrt(avg(x * x)) + 1e-9) AS db FROM {LAYERS} GROUP BY 1, 2)"


@query(
    "v8_energy_mask",
    f"SELECT vec_id, layer, (db > max(db) OVER w - 6 OR count(*) FILTER (db > top - 6) OVER w < 10) AS keep FROM (SELECT *, max(db) OVER (PARTITION BY vec_id) AS top FROM {ENERGY}) WINDOW w AS (PARTITION BY vec_id)",
)
def v8(spark, sf_dir):
    w = Window.partitionBy("vec_id")
    e = layers(spark, sf_dir).groupBy("vec_id", "layer").agg((20 * F.log10(F.sqrt(F.avg(F.col("x") * F.col("x"))) + 1e-9)).alias("db"))
    loud = e.withColumn("loud", F.col("db") > F.max("db").over(w) - 6)
    return loud.select("vec_id", "layer", (F.col("loud") | (F.sum(F.col("loud").cast("int")).over(w) < 10)).alias("keep"))


@query("v11_pca")
def v11(spark, sf_dir):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = emb(spark, sf_dir).select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    rows = V.centred_unit(e, "v", V.mean_vector(e, "v")).select("vec_id", array_to_vector("v").alias("x"))
    out = PCA(k=8, inputCol="x", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.round(V.norm(F.col("p")), 4).alias("norm"))


# clusters and folds

THRESHOLDS = [0.7, 0.75, 0.8, 0.85]


def swept(spark, sf_dir):
    """Average linkage at each threshold, and the similar pairs that it leaves apart."""
    e = emb(spark, sf_dir).select("vec_id", "embedding")
    clusters = written(linkage.clustered(e, "vec_id", "embedding", THRESHOLDS), "clusters")
    return folds.sweep(clusters, relations.leakage(e, "vec_id", "embedding", CUT, clusters))


@query("c1_average_linkage")
def c1(spark, sf_dir):
    return linkage.clustered(emb(spark, sf_dir), "vec_id", "embedding", [0.8]).select("id", "cluster")


SIMILAR = f"(SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {DOT} > {CUT})"


@query("c1_single_linkage", f"WITH RECURSIVE e AS MATERIALIZED {SIMILAR}, r AS (SELECT vec_id AS id, vec_id AS x FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a) SELECT id, min(x) AS cluster FROM r GROUP BY 1")
def c1s(spark, sf_dir):
    e = emb(spark, sf_dir).select("vec_id", "embedding")
    return folds.single_linkage(e, relations.spanning(e, "vec_id", "embedding", CUT), "vec_id")


@query("c2_threshold_sweep")
def c2(spark, sf_dir):
    return swept(spark, sf_dir)


SWEPT = [(0.1, 400, 10, 500, 0.5), (0.2, 300, 20, 500, 0.015), (0.3, 200, 25, 500, 0.01), (0.4, 100, 200, 500, 0.0)]


@query("c3_chosen_threshold", "SELECT 0.2::double AS threshold, 300::bigint AS n_groups, 20::bigint AS largest_group, 500::bigint AS n, 0.015::double AS pair_leak")
def c3(spark, sf_dir):
    return folds.chosen(spark.createDataFrame(SWEPT, "threshold double, n_groups long, largest_group long, n long, pair_leak double"))


@query("c3_chosen_from_sweep")
def c3s(spark, sf_dir):
    return folds.chosen(swept(spark, sf_dir), most_share=0.5).select("threshold", "n_groups", "largest_group")


def folded(spark, sf_dir):
    from gradeworks.operators import binning

    o = binning.quantile_bins(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", 5)
    return folds.folds(o, "o_orderkey", "o_custkey", "bin", 5, (0, 1))


@query("c4_greedy_folds", "SELECT seed::int AS seed, count(*) AS n, count(DISTINCT o_custkey) AS groups, 5::bigint AS folds, 0::bigint AS split_groups, true AS even FROM orders, range(0, 2) r(seed) GROUP BY 1")
def c4(spark, sf_dir):
    """What holds of any good dealing: every row and group is dealt, no group is split, and folds differ by a tenth of their size at most."""
    f = folded(spark, sf_dir)
    by_fold = f.groupBy("seed", "fold").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("groups"))
    split = folds.leaked_groups(f, "o_custkey").groupBy("seed").agg(F.count("*").alias("split_groups"))
    out = by_fold.groupBy("seed").agg(F.sum("n").alias("n"), F.sum("groups").alias("groups"), F.count("*").alias("folds"), (F.max("n") - F.min("n") <= F.sum("n") / 5 * 0.1).alias("even"))
    return out.join(split, "seed", "left").select("seed", "n", "groups", "folds", F.coalesce("split_groups", F.lit(0)).cast("long").alias("split_groups"), "even")


@query("c5_grouped_folds")
def c5(spark, sf_dir):
    return folded(spark, sf_dir)


@query("c5_leaked_groups", "SELECT 0::bigint AS leaked")
def c5l(spark, sf_dir):
    return folds.leaked_groups(folded(spark, sf_dir), "o_custkey").agg(F.count("*").alias("leaked"))


@query("c6_fold_parts", "SELECT held::int AS held, CASE WHEN o_custkey % 5 = held THEN 'valid' ELSE 'train' END AS part, count(*) AS n FROM orders, range(0, 5) r(held) GROUP BY 1, 2")
def c6(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("fold"))
    return folds.train_valid(o, 5).groupBy("held", "part").agg(F.count("*").alias("n"))


@query("c7_pair_leakage", f"SELECT round(avg((a.vec_id % 5 <> b.vec_id % 5)::int), 6) AS leak FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {DOT} > {CUT}")
def c7(spark, sf_dir):
    pairs = relations.similar_pairs(emb(spark, sf_dir), "vec_id", "embedding", CUT)
    return pairs.agg(r6(F.avg((F.col("a") % 5 != F.col("b") % 5).cast("double"))).alias("leak"))


@query("c8_inner_splits", "SELECT (('0x' || substr(md5('0:' || o_custkey), 1, 8))::bigint % 3)::int AS part, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders GROUP BY 1")
def c8(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("part", folds.hashed_fold(F.col("o_custkey"), 3))
    return o.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("groups"))


@query(
    "c9_joint_leak_free",
    """WITH t AS (SELECT l_orderkey, (l_partkey * 100 + l_quantity)::bigint AS lot, (l_orderkey % 3)::int AS fold FROM lineitem), f AS (SELECT k::int AS held FROM range(0, 3) r(k))
    SELECT held, count(*) AS n FROM t, f WHERE fold <> held AND NOT EXISTS (SELECT 1 FROM t v WHERE v.fold = held AND v.l_orderkey = t.l_orderkey) AND NOT EXISTS (SELECT 1 FROM t v WHERE v.fold = held AND v.lot = t.lot) GROUP BY 1""",
)
def c9(spark, sf_dir):
    """Orders are one key; a part in a quantity is the other, which orders of several folds share."""
    lot = (F.col("l_partkey") * 100 + F.col("l_quantity")).cast("long")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", lot.alias("lot"), (F.col("l_orderkey") % 3).cast("int").alias("fold"))
    return folds.joint_free(t, "fold", "l_orderkey", "lot", 3).groupBy("held").agg(F.count("*").alias("n"))


# priors and profiles

PRED = "(3.0 + 0.1 * ((vec_id * 7) % 30))"


@query("k10_label_prior", f"SELECT id, round(CASE WHEN sim > {CUT} THEN 0.5 * p + 0.5 * label ELSE p END, 6)::double AS pred FROM (SELECT c.id, c.sim, b.label, 3.0 + 0.1 * ((c.id * 7) % 30) AS p FROM {CROSS} c JOIN embeddings b ON c.nn = b.vec_id)")
def k10(spark, sf_dir):
    labels = emb(spark, sf_dir).select(F.col("vec_id").alias("nn"), "label")
    rows = cross(spark, sf_dir).join(labels, "nn").withColumn("p", 3.0 + 0.1 * ((F.col("id") * 7) % 30))
    return rows.select("id", r6(stacking.with_prior(F.col("p"), F.col("sim"), F.col("label"), CUT, 0.5)).alias("pred"))


PG = f"""(SELECT e.label::double AS y, 3.0 + 0.1 * ((n.id * 7) % 30) AS p, n.sim, b.label::double AS nl, g.t AS threshold, g.m AS share FROM {NN} n JOIN embeddings e ON e.vec_id = n.id JOIN embeddings b ON b.vec_id = n.nn,
 (SELECT NULL::double AS t, 0.0::double AS m UNION ALL SELECT t::double, m::double FROM (VALUES (0.3), (0.35)) a(t), (VALUES (0.25), (0.5)) b(m)) g)"""


@query(
    "k11_prior_grid",
    f"""SELECT threshold, share, round(avg(CASE WHEN sim > threshold THEN 1.0 ELSE 0.0 END), 6) AS affected, round(0.6 * sqrt(avg((y - q) ** 2)) + 0.4 * (1 - covar_pop(y, q) / sqrt(var_pop(y) * var_pop(q))), 6) AS composite
    FROM (SELECT *, CASE WHEN sim > threshold THEN (1 - share) * p + share * nl ELSE p END AS q FROM {PG}) GROUP BY 1, 2""",
)
def k11(spark, sf_dir):
    labels = emb(spark, sf_dir).select("vec_id", F.col("label").cast("double").alias("y"))
    n = relations.nearest(emb(spark, sf_dir), emb(spark, sf_dir), "vec_id", "embedding")
    rows = n.join(labels.withColumnRenamed("vec_id", "id"), "id").join(labels.select(F.col("vec_id").alias("nn"), F.col("y").alias("nl")), "nn").withColumn("p", 3.0 + 0.1 * ((F.col("id") * 7) % 30))
    return stacking.prior_grid(rows, "y", "p", "sim", "nl", [0.3, 0.35], [0.25, 0.5]).select("threshold", "share", r6("affected").alias("affected"), r6("composite").alias("composite"))


@query("r5_layer_profile")
def r5(spark, sf_dir):
    rows = layers(spark, sf_dir).groupBy("vec_id", "label", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"))
    rows = rows.withColumns({"fold": (F.col("vec_id") % 5).cast("int"), "inner": (F.floor(F.col("vec_id") / 5) % 3).cast("int"), "y": F.col("label").cast("double")})
    out = heads.layer_profile(rows, "vec_id", "layer", "v", "y", "fold", "inner", 5)
    return out.select("layer", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "pearson", "composite")])

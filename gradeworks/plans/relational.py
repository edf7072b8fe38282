"""Queries over sources, projections, joins, aggregations, sorting, bins and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeworks.functions import metrics
from gradeworks.functions import scalars as S
from gradeworks.operators import binning, relations
from gradeworks.plans.registry import query
from gradeworks.sources import files
from gradeworks.sources.scratch import new_path
from gradeworks.sources.tables import table

PREDICTED = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, p_brand, p_size,
 l_extendedprice AS y, l_quantity * p_retailprice AS p, l_quantity AS w FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def r6(c) -> F.Column:
    return F.round(c, 6)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth, prediction and weight of each line: price, quantity times retail price, quantity."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "p_brand", "p_size",
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"), F.col("l_quantity").alias("w"),
    )


def one(name: str, t: str, sql: str):
    """Register a query that reads one table."""

    def keep(f):
        return query(name, sql)(lambda spark, sf_dir: f(table(spark, sf_dir, t)))

    return keep


# sources and sinks


@query("s2_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s2(spark, sf_dir):
    path = new_path(spark, "csv")
    table(spark, sf_dir, "nation").write.csv(path, header=True)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").csv(path, header=True)


@query("s3_id_and_label", "SELECT 'doc_id' AS id_column, 'n_chars' AS label_column")
def s3(spark, sf_dir):
    ident, label = files.id_and_label(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))
    return spark.createDataFrame([(ident, label)], "id_column string, label_column string")


@query("s4_file_resolution", "SELECT 'nation.parquet' AS file")
def s4(spark, sf_dir):
    # the directory stands for the split, whatever it is called
    split = sf_dir.rstrip("/").rsplit("/", 1)[-1]
    return spark.createDataFrame([(files.resolved(spark, sf_dir, split, "nation", ".parquet").rsplit("/", 1)[1],)], "file string")


@query(
    "s5_metadata_union",
    """SELECT CASE WHEN o_orderkey % 5 <> 0 THEN 'train' ELSE 'test' END AS split, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS label,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'train/' ELSE 'test/' END || o_orderkey AS uid, o_orderkey FROM orders""",
)
def s5(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("label"))
    train = F.col("o_orderkey") % 5 != 0
    return files.metadata({"train": o.where(train), "test": o.where(~train).withColumn("label", F.lit(None).cast("double"))}, "o_orderkey").select("split", "label", "uid", "o_orderkey")


@query("s7_column_cache", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def s7(spark, sf_dir):
    path = new_path(spark, "cache")
    table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").write.parquet(path)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"))


@query("s8_jsonl_resume", "SELECT event_type, count(*) AS n, sum(event_id)::bigint AS ids FROM events GROUP BY event_type")
def s8(spark, sf_dir):
    events, path = table(spark, sf_dir, "events").select("event_id", "event_type"), new_path(spark, "log")
    files.appended(events.where("event_id % 3 = 0"), path)
    done = spark.read.schema("event_id long, event_type string").json(path)
    files.appended(files.remaining(events, done, "event_id"), path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("s9_csv_sink", "SELECT r_regionkey, r_name FROM region")
def s9(spark, sf_dir):
    path = new_path(spark, "sink")
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").write.csv(path, header=True)
    return spark.read.schema("r_regionkey int, r_name string").csv(path, header=True)


@query("s10_submission", "SELECT c_custkey, round(avg(o_totalprice), 6) AS pred FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def s10(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(r6(F.avg("o_totalprice")).alias("pred"))
    with_orders = table(spark, sf_dir, "customer").join(orders.select("c_custkey"), "c_custkey", "left_semi").withColumn("place", F.col("c_custkey"))
    return files.submission(with_orders, orders, "c_custkey", "pred", "place")


@query("s11_append_rows", "SELECT run, score::double AS score FROM (VALUES ('run1', 0.5), ('run2', 0.4)) t(run, score)")
def s11(spark, sf_dir):
    path = new_path(spark, "runs")
    for run, score in (("run1", 0.5), ("run2", 0.4)):
        files.appended(spark.createDataFrame([(run, score)], "run string, score double"), path, "parquet")
    return spark.read.parquet(path)


one("s12_column_by_place", "supplier", "SELECT s_name FROM supplier")(lambda t: files.column_at(t, 1))

# projections and filters

one("p1_split_filter", "orders", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")(
    lambda t: t.where("o_orderkey % 5 <> 0").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
)
one("p2_compound_mask", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND NOT l_discount > 0.05")(
    lambda t: t.where((F.col("l_returnflag") == "R") & ~(F.col("l_discount") > 0.05)).select("l_orderkey", "l_linenumber")
)
one("p3_two_condition_gate", "lineitem", "SELECT (l_discount > 0.05 AND l_quantity < 8) AS gated, count(*) AS n FROM lineitem GROUP BY 1")(
    lambda t: t.groupBy(S.gate(F.col("l_discount"), 0.05, F.col("l_quantity"), 8).alias("gated")).agg(F.count("*").alias("n"))
)
one("p5_columns_by_exclusion", "part", "SELECT * EXCLUDE (p_name, p_type) FROM part")(lambda t: t.drop("p_name", "p_type"))
one("p6_clip", "customer", "SELECT c_custkey, greatest(0.0, least(5000.0, c_acctbal)) AS clipped FROM customer")(lambda t: t.select("c_custkey", S.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped")))
one("p7_overwrite", "lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 AND l_quantity < 8 THEN 0.0 ELSE l_extendedprice END AS price FROM lineitem")(
    lambda t: t.select("l_orderkey", "l_linenumber", F.when(S.gate(F.col("l_discount"), 0.05, F.col("l_quantity"), 8), 0.0).otherwise(F.col("l_extendedprice")).alias("price"))
)
one(
    "p8_population_bucket",
    "documents",
    "SELECT CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 5000 THEN 2 ELSE 3 END AS pop, count(*) AS n FROM documents GROUP BY 1",
)(lambda t: t.groupBy(S.bucket(F.col("n_chars"), [500, 1000, 5000]).alias("pop")).agg(F.count("*").alias("n")))
one("p10_key_split", "documents", "SELECT split_part(source || '/' || doc_id, '/', 1) AS part, count(*) AS n, min(source || '/' || doc_id) AS first_uid FROM documents GROUP BY 1")(
    lambda t: t.withColumn("uid", F.concat_ws("/", "source", F.col("doc_id").cast("string"))).groupBy(F.split_part("uid", F.lit("/"), F.lit(1)).alias("part")).agg(F.count("*").alias("n"), F.min("uid").alias("first_uid"))
)
one("p11_pool_filter", "part", "SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9)")(lambda t: t.where(F.col("p_size").isin(1, 5, 9)).select("p_partkey", "p_brand"))
one("p13_slice", "embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding[5:20], lambda x: x::double)), 6) AS s FROM embeddings")(
    lambda t: t.select("vec_id", r6(F.aggregate(F.slice(F.col("embedding").cast("array<double>"), 5, 16), F.lit(0.0), lambda a, x: a + x)).alias("s"))
)


@query("p4_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p4(spark, sf_dir):
    some = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(some, "o_custkey", "left_semi").select("o_orderkey")


@query("p9_equality_flag", "SELECT doc_id, coalesce(quality = 0, false) AS is_zero FROM documents LEFT JOIN labels USING (doc_id)")
def p9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", S.flag(F.col("quality"), 0).alias("is_zero"))


UNIT = "((((12345 * 7919 + {a} * 104729 + 17) % 1000003) * 7919 + {b} * 104729 + 17) % 1000003) / 1000003.0"


@query(
    "p12_crop_plan",
    f"""SELECT doc_id, crop, round(least(40 + 10 * {UNIT.format(a='doc_id', b='crop')}, n_chars / 15.0), 3) AS len_s,
    round(greatest(n_chars / 15.0 - least(40 + 10 * {UNIT.format(a='doc_id', b='crop')}, n_chars / 15.0), 0) * {UNIT.format(a='doc_id', b='(crop + 2)')}, 3) AS start_s
    FROM documents, (VALUES (0), (1)) c(crop)""",
)
def p12(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 15.0).alias("seconds"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("crop"))
    length = F.least(40 + 10 * S.hashed_unit(F.col("doc_id"), F.col("crop")), F.col("seconds"))
    start = F.greatest(F.col("seconds") - length, F.lit(0.0)) * S.hashed_unit(F.col("doc_id"), F.col("crop") + 2)
    return rows.select("doc_id", "crop", F.round(length, 3).alias("len_s"), F.round(start, 3).alias("start_s"))


# joins and lookups


def orders_customers(spark, sf_dir, how="inner"):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, how)


@query("j1_inner_join", "SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def j1(spark, sf_dir):
    return orders_customers(spark, sf_dir).groupBy("c_mktsegment").agg(F.count("*").alias("n"), r6(F.avg("o_totalprice")).alias("mean_price"))


@query("j2_keyed_reindex", "SELECT l.doc_id, lang, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def j2(spark, sf_dir):
    values = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return relations.reindexed(table(spark, sf_dir, "labels").select("doc_id"), values, "doc_id", "doc_id").select("doc_id", "lang", "n_chars")


@query("j3_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j3(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("j4_map_left", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def j4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("j5_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)")
def j5(spark, sf_dir):
    train = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(train, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("j6_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j6(spark, sf_dir):
    return files.remaining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


DAY5 = 432000.0
TIMED = "(SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS e FROM events)"


def timed(spark, sf_dir):
    s = S.epoch("ts")
    return table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("s"), (s + F.col("value")).alias("e"))


@query(
    "j7_interval_join",
    f"""WITH t AS {TIMED}, b AS (SELECT user_id, min(s) AS s0, max(s) AS s1 FROM t GROUP BY 1),
    w AS (SELECT user_id, k, s0 + k * {DAY5} AS lo, s0 + (k + 1) * {DAY5} AS hi FROM b, range(0, 100) r(k) WHERE s0 + k * {DAY5} <= s1)
    SELECT t.user_id, k, count(*) AS n FROM t JOIN w ON t.user_id = w.user_id AND 0.5 * (s + e) >= lo AND 0.5 * (s + e) < hi GROUP BY 1, 2""",
)
def j7(spark, sf_dir):
    t = timed(spark, sf_dir)
    ends = t.groupBy("user_id").agg(F.min("s").alias("s0"), F.max("s").alias("s1"))
    k = F.explode(F.sequence(F.lit(0), F.least(F.floor((F.col("s1") - F.col("s0")) / DAY5), F.lit(99)).cast("int"))).alias("k")
    w = ends.select("user_id", "s0", k).select("user_id", "k", (F.col("s0") + F.col("k") * DAY5).alias("lo"), (F.col("s0") + (F.col("k") + 1) * DAY5).alias("hi"))
    return relations.in_intervals(t, w, "user_id", "s", "e", "lo", "hi", DAY5).groupBy("user_id", F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("j11_grid", "SELECT t.x::double AS threshold, m.x::double AS share FROM (VALUES (0.1), (0.2), (0.3)) t(x), (VALUES (0.25), (0.5)) m(x)")
def j11(spark, sf_dir):
    grid = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} double")
    return grid([0.1, 0.2, 0.3], "threshold").crossJoin(grid([0.25, 0.5], "share"))


@query("j12_ordinal_zip", "SELECT a.conv_id, a.turn, length(a.text) AS chars, length(b.text) AS next_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def j12(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("chars").alias("next_chars"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", "chars", "next_chars")


@query("j13_fan_in", "SELECT l_orderkey, l_linenumber, o_custkey AS grp, o_totalprice AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j13(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("label"))


# aggregations

STATS = ("count", "mean", "std", "min", "q1", "median", "q3", "max")
one("a1_group_count", "documents", "SELECT source, count(*) AS n FROM documents GROUP BY 1")(lambda t: t.groupBy("source").agg(F.count("*").alias("n")))


@query(
    "a2_describe",
    """SELECT lang, count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, round(quantile_cont(n_chars, 0.25), 6) AS q1,
    round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS q3, max(n_chars) AS max FROM documents GROUP BY 1""",
)
def a2(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("lang", "n_chars")
    plain = t.groupBy("lang").agg(F.count("n_chars").alias("count"), r6(F.avg("n_chars")).alias("mean"), r6(F.stddev_samp("n_chars")).alias("std"), F.min("n_chars").alias("min"), F.max("n_chars").alias("max"))
    ranks = binning.group_quantiles(t, "lang", "n_chars", [0.25, 0.5, 0.75]).select(F.col("lang").alias("g"), "q")
    out = plain.join(ranks, F.col("lang").eqNullSafe(F.col("g")), "left")
    return out.select("lang", "count", "mean", "std", "min", *[r6(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "max")


@query("a3_median", "SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1")
def a3(spark, sf_dir):
    return binning.group_quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", [0.5]).select("l_returnflag", F.get("q", F.lit(0)).alias("med"))


one("a4_count_mean_std", "orders", "SELECT o_orderkey % 5 AS fold, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std FROM orders GROUP BY 1")(
    lambda t: t.groupBy((F.col("o_orderkey") % 5).alias("fold")).agg(F.count("*").alias("n"), r6(F.avg("o_totalprice")).alias("mean"), r6(F.stddev_samp("o_totalprice")).alias("std"))
)
one(
    "a5_named_aggregates",
    "lineitem",
    "SELECT l_linestatus, round(avg(abs(l_quantity - 25)), 6) AS mean_abs_dy, round(avg(CASE WHEN l_quantity = 25 THEN 1.0 ELSE 0.0 END), 6) AS exact_match FROM lineitem GROUP BY 1",
)(lambda t: t.groupBy("l_linestatus").agg(r6(F.avg(F.abs(F.col("l_quantity") - 25))).alias("mean_abs_dy"), r6(F.avg(F.when(F.col("l_quantity") == 25, 1.0).otherwise(0.0))).alias("exact_match")))
one("a6_distinct_per_group", "orders", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1")(
    lambda t: t.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds"))
)
one("a7_set_aggregate", "documents", "SELECT langs, count(*) AS n FROM (SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1) GROUP BY 1")(
    lambda t: t.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs")).groupBy("langs").agg(F.count("*").alias("n"))
)
one("a8_crosstab", "lineitem", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")(
    lambda t: t.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)
)


@query("a9_crosstab_share", "SELECT lang, source, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source")
def a9(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.select("lang", "source", r6(F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("share"))


@query("a10_histogram", "SELECT k::int AS size, coalesce(n, 0)::bigint AS n FROM range(0, 61) r(k) LEFT JOIN (SELECT p_size, count(*) AS n FROM part GROUP BY 1) ON p_size = k")
def a10(spark, sf_dir):
    return binning.histogram(table(spark, sf_dir, "part").select(F.col("p_size").alias("size")), "size", 61)


A11 = "SELECT o_orderkey, {} AS mean_qty FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey"


def scattered(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("m"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(m, "o_orderkey", "left")


query("a11_scatter_mean", A11.format("round(m, 6)"))(lambda s, d: scattered(s, d).select("o_orderkey", r6("m").alias("mean_qty")))
query("a11b_scatter_mean_zero", A11.format("round(coalesce(m, 0), 6)"))(lambda s, d: scattered(s, d).select("o_orderkey", r6(F.coalesce("m", F.lit(0.0))).alias("mean_qty")))
one("a12_weighted_mean", "lineitem", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS m FROM lineitem GROUP BY 1")(
    lambda t: t.groupBy("l_returnflag").agg(r6(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity")).alias("m"))
)
@query("a13_percentile_spread", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95) - quantile_cont(l_extendedprice, 0.05), 6) AS spread FROM lineitem GROUP BY 1")
def a13(spark, sf_dir):
    q = binning.group_quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", [0.05, 0.95])
    return q.select("l_returnflag", r6(F.get("q", F.lit(1)) - F.get("q", F.lit(0))).alias("spread"))


one("a14_conditional_share", "documents", "SELECT lang, round(avg((n_chars > 1000)::int), 6) AS share FROM documents GROUP BY 1")(
    lambda t: t.groupBy("lang").agg(r6(F.avg((F.col("n_chars") > 1000).cast("double"))).alias("share"))
)
one("a15_argmin", "orders", "SELECT o_custkey, o_orderkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")(
    lambda t: relations.first_by(t, ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("best"))
)
PEARSON = "CASE WHEN var_pop({y}) <= 0 OR var_pop({p}) <= 0 THEN 0.0 ELSE covar_pop({y}, {p}) / sqrt(CASE WHEN var_pop({y}) > 0 AND var_pop({p}) > 0 THEN var_pop({y}) * var_pop({p}) END) END"
RP = PEARSON.format(y="y", p="p")


@query(
    "a16_group_metrics",
    f"SELECT p_size, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round({RP}, 6) AS pearson, round(avg(p - y), 6) AS bias FROM {PREDICTED} GROUP BY 1 HAVING count(*) >= 5",
)
def a16(spark, sf_dir):
    return metrics.report(predicted(spark, sf_dir), ["p_size"], "y", "p").where("n >= 5").select("p_size", "n", *[r6(c).alias(c) for c in ("rmse", "pearson", "bias")])


FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query(
    "a17_feature_correlation",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, round({PEARSON.format(y='l_extendedprice', p=f)}, 6) AS r FROM lineitem" for f in FEATURES),
)
def a17(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", *[F.col(f).cast("double").alias(f) for f in FEATURES])
    long = li.unpivot("l_extendedprice", list(FEATURES), "feature", "x")
    out = long.groupBy("feature").agg(r6(metrics.pearson(F.col("l_extendedprice"), F.col("x"))).alias("r"))
    return out.orderBy(F.abs("r").desc(), "feature")


@query("a18_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({PEARSON.format(y=a, p=b)}, 6) AS r FROM lineitem" for a in FEATURES for b in FEATURES))
def a18(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*[F.col(f).cast("double").alias(f) for f in FEATURES])
    cells = li.agg(*[metrics.pearson(F.col(a), F.col(b)).alias(f"{a}|{b}") for a in FEATURES for b in FEATURES])
    return cells.unpivot([], cells.columns, "pair", "r").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), r6("r").alias("r"))


one("a19_confusion_trace", "labels", "SELECT count(*) FILTER (quality = toxic) AS trace, count(*) AS n FROM labels")(lambda t: t.agg(F.count_if(F.col("quality") == F.col("toxic")).alias("trace"), F.count("*").alias("n")))
one("a20_mean_over_models", "lineitem", "SELECT l_partkey, round(avg(l_discount), 6) AS mean_pred FROM lineitem GROUP BY 1")(lambda t: t.groupBy("l_partkey").agg(r6(F.avg("l_discount")).alias("mean_pred")))


@query(
    "a21_shifted_baseline",
    "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT round(avg((a.label = b.label)::int), 6) AS match, round(avg(abs(a.label - b.label)), 6) AS abs_diff FROM embeddings a, n JOIN embeddings b ON b.vec_id = (a.vec_id + 37) % n.n",
)
def a21(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = e.agg(F.count("*").alias("n"))
    a = e.crossJoin(F.broadcast(n)).select(((F.col("vec_id") + 37) % F.col("n")).alias("vec_id"), F.col("label").alias("other"))
    return a.join(e, "vec_id").agg(r6(F.avg((F.col("label") == F.col("other")).cast("double"))).alias("match"), r6(F.avg(F.abs(F.col("label") - F.col("other")))).alias("abs_diff"))


@query(
    "a22_density_histogram",
    """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT (greatest(1, ceil((l_extendedprice - lo) / (hi - lo) * 40)) - 1)::int AS bin, count(*) AS n FROM lineitem, b GROUP BY 1""",
)
def a22(spark, sf_dir):
    return binning.equal_bins(table(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", 40).groupBy("bin").agg(F.count("*").alias("n"))


# sorting, limits, sets

one("o1_sort_by_key", "part", "SELECT p_partkey, abs(p_retailprice - 1500) AS d FROM part")(lambda t: t.select("p_partkey", F.abs(F.col("p_retailprice") - 1500).alias("d")).orderBy(F.desc("d"), "p_partkey"))
one("o2_head", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda t: t.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10))
one("o2_tail", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 10")(lambda t: t.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", F.desc("o_orderkey")).limit(10))
one("o3_size_order", "orders", "SELECT o_custkey, count(*) AS n, (o_custkey * 7919) % 1000003 AS turn FROM orders GROUP BY o_custkey")(
    lambda t: t.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("turn", F.col("o_custkey") * 7919 % 1000003).orderBy(F.desc("n"), "turn")
)


@query("o4_union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def o4(spark, sf_dir):
    c, s = (table(spark, sf_dir, n).select(F.col(k).alias("k")) for n, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return c.unionByName(s).groupBy("k").agg(F.count("*").alias("n"))


@query("o5_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def o5(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


one("o6_distinct", "part", "SELECT DISTINCT p_brand, p_size FROM part")(lambda t: t.select("p_brand", "p_size").distinct())
one("o7_column_stack", "events", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")(
    lambda t: t.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1))).na.fill(0)
)

# bins and weights

B1 = """WITH e AS (SELECT list_distinct(list_transform(quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda x: round(x, 9))) AS e FROM lineitem)
 SELECT greatest(0, len(list_filter(e, lambda x: x < l_extendedprice)) - 1)::int AS bin, count(*) AS n FROM lineitem, e GROUP BY 1"""
one("b1_quantile_bins", "lineitem", B1)(lambda t: binning.quantile_bins(t.select("l_extendedprice"), "l_extendedprice", 5).groupBy("bin").agg(F.count("*").alias("n")))
EIGHT = "(SELECT l_orderkey, l_linenumber, (greatest(1, ceil((l_quantity - lo) / (hi - lo) * 8)) - 1)::int AS bin FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem))"
one("b2_equal_bins", "lineitem", f"SELECT bin, count(*) AS n FROM {EIGHT} GROUP BY 1")(lambda t: binning.equal_bins(t.select("l_quantity"), "l_quantity", 8).groupBy("bin").agg(F.count("*").alias("n")))
one(
    "b3_rarity_weights",
    "lineitem",
    f"""WITH c AS (SELECT bin, count(*) AS n, sqrt(1.0 / count(*)) AS w FROM {EIGHT} GROUP BY 1), m AS (SELECT sum(n * w) / sum(n) AS m FROM c)
    SELECT l_orderkey, l_linenumber, round(w / m, 6) AS weight FROM {EIGHT} JOIN c USING (bin), m""",
)(lambda t: binning.rarity_weights(binning.equal_bins(t.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 8), "bin").select("l_orderkey", "l_linenumber", r6("weight").alias("weight")))
POP = "CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 5000 THEN 2 ELSE 3 END"


@query(
    "b4_importance_weights",
    f"""WITH d AS (SELECT doc_id, {POP} AS pop FROM documents), tr AS (SELECT pop, count(*) AS n FROM d WHERE doc_id % 5 <> 0 GROUP BY 1), te AS (SELECT pop, count(*) AS n FROM d WHERE doc_id % 5 = 0 GROUP BY 1),
    r AS (SELECT tr.pop, tr.n, coalesce(te.n / (SELECT sum(n) FROM te), 0.0) / greatest(tr.n / (SELECT sum(n) FROM tr), 1e-9) AS w FROM tr LEFT JOIN te USING (pop))
    SELECT pop, round(w / (SELECT sum(n * w) / sum(n) FROM r), 6) AS weight, n FROM r""",
)
def b4(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", S.bucket(F.col("n_chars"), [500, 1000, 5000]).alias("pop"))
    out = binning.importance_weights(d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0"), "pop")
    return out.groupBy("pop").agg(r6(F.max("weight")).alias("weight"), F.count("*").alias("n"))


one("b5_one_hot", "documents", f"SELECT doc_id, {', '.join(f'CASE WHEN {POP} = {i} THEN 1.0::double ELSE 0.0::double END AS pop{i}' for i in range(4))} FROM documents")(
    lambda t: binning.one_hot(t.select("doc_id", S.bucket(F.col("n_chars"), [500, 1000, 5000]).alias("pop")), "pop", [0, 1, 2, 3], "pop").drop("pop")
)

# metrics

RMSE = "sqrt(avg((y - p) * (y - p)))"
WP = """CASE WHEN sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2 <= 0 OR sum(w * p * p) / sum(w) - (sum(w * p) / sum(w)) ** 2 <= 0 THEN 0.0
 ELSE (sum(w * y * p) / sum(w) - sum(w * y) / sum(w) * sum(w * p) / sum(w)) / sqrt((sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2) * (sum(w * p * p) / sum(w) - (sum(w * p) / sum(w)) ** 2)) END"""


def brand(cols):
    return lambda spark, sf_dir: metrics.report(predicted(spark, sf_dir), ["p_brand"], "y", "p").select("p_brand", *[r6(c).alias(c) for c in cols])


query("e1_rmse", f"SELECT p_brand, round({RMSE}, 6) AS rmse FROM {PREDICTED} GROUP BY 1")(brand(["rmse"]))
query("e2_pearson", f"SELECT p_brand, round({RP}, 6) AS pearson FROM {PREDICTED} GROUP BY 1")(brand(["pearson"]))
query("e3_composite_by_brand", f"SELECT p_brand, round({RMSE}, 6) AS rmse, round({RP}, 6) AS pearson, round(0.6 * {RMSE} + 0.4 * (1 - {RP}), 6) AS composite FROM {PREDICTED} GROUP BY 1")(brand(["rmse", "pearson", "composite"]))


@query("e1_e2_weighted", f"SELECT p_brand, round(sqrt(sum(w * (y - p) * (y - p)) / sum(w)), 6) AS rmse_w, round({WP}, 6) AS pearson_w FROM {PREDICTED} GROUP BY 1")
def e12w(spark, sf_dir):
    return metrics.report(predicted(spark, sf_dir), ["p_brand"], "y", "p", "w").select("p_brand", r6("rmse").alias("rmse_w"), r6("pearson").alias("pearson_w"))


@query("e4_composite_equal", f"SELECT p_brand, round(0.5 * {RMSE} + 0.5 * (1 - {RP}), 6) AS composite FROM {PREDICTED} GROUP BY 1")
def e4(spark, sf_dir):
    return metrics.report(predicted(spark, sf_dir), ["p_brand"], "y", "p").select("p_brand", r6(metrics.composite_equal(F.col("rmse"), F.col("pearson"))).alias("composite"))


@query("e8_report_row", f"SELECT 'model' AS name, count(*) AS n, round({RMSE}, 6) AS rmse, round({RP}, 6) AS pearson, round(0.6 * {RMSE} + 0.4 * (1 - {RP}), 6) AS composite FROM {PREDICTED}")
def e8(spark, sf_dir):
    return metrics.report(predicted(spark, sf_dir), [], "y", "p").select(F.lit("model").alias("name"), "n", *[r6(c).alias(c) for c in ("rmse", "pearson", "composite")])


@query(
    "e9_cv_summary",
    f"SELECT round(avg(c), 6) AS composite, round(stddev_pop(c), 6) AS sd FROM (SELECT l_orderkey % 3 AS seed, 0.6 * {RMSE} + 0.4 * (1 - {RP}) AS c FROM {PREDICTED} GROUP BY 1)",
)
def e9(spark, sf_dir):
    by_seed = metrics.report(predicted(spark, sf_dir).withColumn("seed", F.col("l_orderkey") % 3), ["seed"], "y", "p")
    return by_seed.agg(r6(F.avg("composite")).alias("composite"), r6(F.stddev_pop("composite")).alias("sd"))

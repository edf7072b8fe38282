"""Queries along an order: gaps, moving means, bands, windows of time, segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeworks.operators import sequences, stacking
from gradeworks.plans.registry import query
from gradeworks.plans.relational import TIMED, r6, timed
from gradeworks.sources.tables import table

#: Pause bounds for the events table, whose gaps last hours: 6 h and 24 h.
SHORT, LONG = 21600.0, 86400.0
GAPS = f"(SELECT *, CASE WHEN lag(e) OVER w IS NOT NULL THEN greatest(s - lag(e) OVER w, 0) END AS gap FROM {TIMED} WINDOW w AS (PARTITION BY user_id ORDER BY s, e))"


@query("w1_group_mean_broadcast", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS m FROM orders")
def w1(spark, sf_dir):
    return stacking.smoothed(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 1.0, "m").select("o_orderkey", r6("m").alias("m"))


@query("w2_lag_gap", f"SELECT user_id, event_id, round(gap, 3) AS gap FROM {GAPS}")
def w2(spark, sf_dir):
    return sequences.gaps(timed(spark, sf_dir), "user_id", "s", "e").select("user_id", "event_id", F.round("gap", 3).alias("gap"))


@query("w6_moving_mean", "SELECT event_id, round(m, 6) AS m FROM (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4")
def w6(spark, sf_dir):
    return sequences.moving_mean(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 4).select("event_id", r6("moving").alias("m"))


#: A layer's score of a group of parts: its mean size deviation, from a layer number in arithmetic both engines share.
PROFILE = "(SELECT p_brand, (p_partkey % 16)::int AS layer, round(avg(p_retailprice), 6) AS score FROM part GROUP BY 1, 2)"
BAND = f"""m AS (SELECT * FROM (SELECT p_brand, layer, avg(score) OVER w AS m, count(*) OVER w AS n FROM {PROFILE} WINDOW w AS (PARTITION BY p_brand ORDER BY layer ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4),
 a AS (SELECT p_brand, layer AS a_start FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY m, layer) AS r FROM m) WHERE r = 1)"""


def profile(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_partkey") % 16).cast("int").alias("layer")).agg(r6(F.avg("p_retailprice")).alias("score"))


@query(
    "w7_two_bands",
    f"""WITH {BAND}, b AS (SELECT p_brand, layer AS b_start FROM (SELECT m.*, row_number() OVER (PARTITION BY m.p_brand ORDER BY m, layer) AS r FROM m JOIN a USING (p_brand) WHERE abs(layer - a_start) >= 4) WHERE r = 1)
    SELECT p_brand, a_start, a_start + 4 AS a_end, b_start, b_start + 4 AS b_end FROM a LEFT JOIN b USING (p_brand)""",
)
def w7(spark, sf_dir):
    return sequences.best_bands(profile(spark, sf_dir), ["p_brand"], "layer", "score")


@query("w8_best_band", f"WITH {BAND} SELECT p_brand, a_start, a_start + 4 AS a_end FROM a")
def w8(spark, sf_dir):
    return sequences.best_bands(profile(spark, sf_dir), ["p_brand"], "layer", "score").select("p_brand", "a_start", "a_end")


@query(
    "w10_time_windows",
    f"""WITH t AS {TIMED}, b AS (SELECT user_id, min(s) AS t0, max(s) AS t1 FROM t GROUP BY 1)
    SELECT user_id, floor((s - t0) / 604800.0)::bigint AS win, count(*) AS n FROM t JOIN b USING (user_id)
    WHERE NOT (floor((s - t0) / 604800.0) = floor((t1 - t0) / 604800.0) AND (t1 - t0) - floor((t1 - t0) / 604800.0) * 604800.0 < 86400 AND floor((s - t0) / 604800.0) > 0) GROUP BY 1, 2""",
)
def w10(spark, sf_dir):
    out = sequences.tumbling(timed(spark, sf_dir), "user_id", "s", 604800.0, 86400.0)
    return out.groupBy("user_id", F.col("window").alias("win")).agg(F.count("*").alias("n"))


@query(
    "w11_segment_means",
    """WITH e AS (SELECT j::int AS segment, round_even(j * (64 / 5), 0)::int AS a, round_even((j + 1) * (64 / 5), 0)::int AS b FROM range(0, 5) r(j))
    SELECT vec_id, segment, round(avg(embedding[i]::double), 6) AS mean FROM embeddings, e, range(1, 65) r(i) WHERE i > a AND i <= b GROUP BY 1, 2""",
)
def w11(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return sequences.segment_means(e, "vec_id", "v", 5).select("vec_id", "segment", r6("mean").alias("mean"))


@query("w12_centre_window", "SELECT vec_id, round(list_sum(list_transform(embedding[25:40], lambda x: x::double)), 6) AS total, round(embedding[25]::double, 6) AS first FROM embeddings")
def w12(spark, sf_dir):
    middle = F.slice("embedding", F.floor((F.size("embedding") - 16) / 2).cast("int") + 1, 16).cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", middle.alias("v"))
    return rows.select("vec_id", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.get("v", F.lit(0))).alias("first"))


@query("w13_part_column", "SELECT 'train' AS part, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'valid', count(*) FROM orders WHERE o_orderkey % 5 = 0")
def w13(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.when(F.col("o_orderkey") % 5 != 0, "train").otherwise("valid").alias("part")).agg(F.count("*").alias("n"))


RATES = {
    "articulation_rate": "count(*) / greatest(sum(greatest(e - s, 0)), 1e-3)",
    "pause_per_min": f"count(*) FILTER (gap > {SHORT}) / (greatest(max(e) - min(s), 1.0) / 60)",
    "long_pause_per_min": f"count(*) FILTER (gap > {LONG}) / (greatest(max(e) - min(s), 1.0) / 60)",
    "mean_pause_s": f"coalesce(avg(gap) FILTER (gap > {SHORT}), 0.0)",
    "pause_time_frac": f"coalesce(sum(gap) FILTER (gap > {SHORT}), 0.0) / greatest(max(e) - min(s), 1.0)",
}


def pause_query(name: str, sql: str) -> None:
    @query(f"t11_{name}", f"SELECT user_id, round({sql}, 6) AS {name} FROM {GAPS} GROUP BY 1")
    def run(spark, sf_dir):
        return sequences.pause_rates(timed(spark, sf_dir), "user_id", "s", "e", SHORT, LONG).select("user_id", r6(name).alias(name))


for _name, _sql in RATES.items():
    pause_query(_name, _sql)

"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm import decontamination, digests, langid, lines, mixing, negatives, pii, quality, search, sharding, simhash, substrings, warc
from gradeworks.sources.tables import table


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identified(docs)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.decided(table(spark, sf_dir, "documents"), pieces=True).select("doc_id", "n_lines", "n_dropped", (F.col("n_lines") - F.col("n_dropped")).alias("n_kept"), "dropped")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_out(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.round_trip(table(spark, sf_dir, "pages"), with_data=False).where("is_last")
    return chunks.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.extracted(table(spark, sf_dir, "documents"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    base, spans = F.coalesce("base", none), F.coalesce("spans", none)
    kinds = F.transform(base, lambda s: s["kind"])
    n = [F.size(F.array_remove(F.transform(kinds, lambda x: x == F.lit(k)), F.lit(False))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]  # noqa: B023
    return out.select("doc_id", *n, F.sha2(pii.written_out(base), 256).alias("base_sha256"), pii.written_out(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.matched(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", (F.size("__items") > 0).alias("contaminated"), F.size("__items").alias("n_items"), F.col("__items").alias("items"), F.array_min("__distances").alias("least_distance")
    )


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.built(table(spark, sf_dir, "documents"))
    return search.searched(index, table(spark, sf_dir, "benchmark")).select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = digests.judged(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(ident % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mined(rows, "vec_id", "embedding", "label", ident % 100 == 0)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
    "op11_search": op11_search,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}
#: The digest's 160 bits come as 40 hexadecimal digits: five of them make four letters.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::bigint AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::bigint) AS g FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to,
  CASE WHEN page_id > first THEN 1 ELSE greatest(1, ceil(payload_bytes / 1048576.0)) END::bigint AS n_chunks
FROM g
"""

#: Terms with A-Z lower-cased alone; ``//`` divides whole numbers.
TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {TERMS_SQL} AS t FROM documents),
size AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*)::bigint AS docs, sum(n)::bigint AS terms FROM size),
posting AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2.0 * docs + 2) / (2 * df + 1)))::bigint AS w FROM (SELECT term, count(*) AS df FROM posting GROUP BY 1), total),
hit AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint AS score
 FROM asked JOIN posting USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM hit WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS q
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label <> b.label AS other, list_inner_product(a.q, b.q)::bigint AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE NOT other QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::int AS rank, vec_id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE other AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op3_warc": OP3_SQL, "op11_search": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}

"""Steps whose work must grow no faster than the input: each would take minutes, or a plan many times as large, if done row by row with itself."""

from time import monotonic

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gradeworks.functions import scalars, text
from gradeworks.operators import features, resampling
from gradeworks.plans import registry


def test_different_bigrams_of_a_long_text_are_hashed(spark):
    n = 80_000  # 3.2 billion comparisons, if each pair met each
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), F.pmod(i.cast("long") * i, F.lit(n - 9)).cast("string"))).alias("t"))
    start = monotonic()
    got = df.select("t", text.distinct_bigrams(F.col("t")).alias("kinds"), text.text_rates(F.lit(""), F.lit(1.0), F.col("t"))["bigram_repeat_rate"].alias("rate")).first()
    assert monotonic() - start < 15
    words = got.t
    want = len(set(zip(words, words[1:], strict=False)))
    assert got.kinds == want and abs(got.rate - (n - 1 - want) / (n - 1)) < 1e-12
    few = spark.createDataFrame([([],), (["a"],), (["a", "a"],), (["a", "a", "a", "b"],)], "t array<string>")
    assert [r[0] for r in few.select(text.distinct_bigrams(F.col("t"))).collect()] == [0, 0, 1, 2]


def test_words_of_a_long_text_are_made_once_for_all_its_chunks(spark):
    n = 120_000  # 8,000 chunks: made anew for each, the words would be found in a gigabyte of text and more
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), F.translate(i.cast("string"), "0123456789", "abcdefghij"))), " ").alias("t"))
    start = monotonic()
    got = df.select(text.chunks(text.tokens(F.col("t"))).alias("c")).select(F.size("c").alias("n"), F.element_at("c", -1).alias("last"), F.get("c", F.lit(0)).alias("first")).first()
    assert monotonic() - start < 15
    words = ["w" + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(1, n + 1)]
    assert (got.n, got.first, got.last) == (8000, " ".join(words[:15]), " ".join(words[-15:]))


def test_logits_and_sorted_words_are_made_once(spark):
    logits = F.array(F.length(F.upper("t")) / 1.0, F.lit(1.0))
    plan = spark.createDataFrame([("a",)], "t string").select(scalars.softmax_terms(logits).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
    ranked = spark.createDataFrame([(["a"],)], "t array<string>").select(text.mattr(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert ranked.count("sort_array(") == 1 and "array_sort(" not in ranked  # the one takes a comparison by an expression for each two words


def test_a_table_resolves_in_any_folder_and_as_a_folder_of_parts(spark, tmp_path):
    for name, parts in (("data-0.1", 1), ("gb1", 3)):
        folder = tmp_path / name
        spark.range(9).repartition(parts).write.parquet(str(folder / "nation.parquet"))
        spark.range(9).write.parquet(str(folder / "not-nation.parquet"))
        for given in (str(folder), f"{folder}/", f"file://{folder}"):
            assert [r.file for r in registry.QUERIES["s4_file_resolution"](spark, given).collect()] == ["nation.parquet"]


def test_resamples_of_many_rows_do_not_cost_rows_times_resamples(spark, monkeypatch):
    n, times = 600_000, 2000
    df = spark.range(0, n, 1, 1).select("id", (F.col("id") % 97).cast("double").alias("y"), (F.col("id") % 89).cast("double").alias("p"))
    start = monotonic()
    got = {r.resample: r for r in resampling.repeated_sums(df, "id", "y", ["p"], times, [resampling.drawn()]).collect()}
    assert monotonic() - start < 20  # 1.2 billion draws in one task
    i = np.arange(n, dtype=np.int64)
    y, p = (i % 97).astype(float), (i % 89).astype(float)
    for r in (0, 1, 1234, 1999):
        m = (resampling.SEED * resampling.MIX + i % resampling.MODULUS * resampling.STEP + resampling.ADD) % resampling.MODULUS
        w = resampling.drawn()[(m * resampling.MIX + r * resampling.STEP + resampling.ADD) % resampling.MODULUS].astype(float)
        want = [w.sum(), (w * y).sum(), (w * y * y).sum(), (w * (y - p) ** 2).sum(), (w * p).sum(), (w * p * p).sum(), (w * y * p).sum()]
        assert np.allclose([got[r][c] for c in ("w", "wy", "wyy", "e_p", "p_p", "pp_p", "yp_p")], want, rtol=1e-11)
    small = df.limit(900)
    plain = {r.resample: list(r)[2:] for r in resampling.repeated_sums(small, "id", "y", ["p"], 50, [resampling.drawn()]).collect()}
    monkeypatch.setattr(resampling, "FEW", 10)
    turned = {r.resample: list(r)[2:] for r in resampling.repeated_sums(small, "id", "y", ["p"], 50, [resampling.drawn()]).collect()}
    assert all(np.allclose(plain[r], turned[r], rtol=1e-9, atol=1e-6) for r in plain)


def test_tfidf_of_odd_rows_shuffles_no_row_of_a_document_and_term(spark, monkeypatch):
    monkeypatch.setattr(features, "BLOCK_CHARS", 30)
    given = [(1, "Aa bb aa cc"), (2, None), (3, ""), (4, "bb aa dd"), (4, "dd Aa"), (None, "cc aa bb"), (5, "x yy")]
    df = spark.createDataFrame(given, "id long, text string").repartition(3)
    out = features.tfidf(df, "id", "text", features.word_terms)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate [id" not in plan
    tf = {}
    for i, t in given:
        w = [x for x in (t or "").lower().split() if len(x) > 1]
        for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]:
            tf[i, x] = tf.get((i, x), 0) + 1
    df_ = {x: sum(1 for _, y in tf if y == x) for _, x in tf}
    raw = {(i, x): (1 + np.log(c)) * (np.log((1 + len(given)) / (1 + df_[x])) + 1) for (i, x), c in tf.items() if df_[x] >= 2}
    length = {i: np.sqrt(sum(v * v for (j, _), v in raw.items() if i == j)) for i, _ in raw}
    got = {(r.id, r.term): r.weight for r in out.collect()}
    assert got.keys() == raw.keys() and all(abs(got[k] - raw[k] / length[k[0]]) < 1e-12 for k in raw)
    runs = features.tfidf(df, "id", "text", features.character_terms, 1, 3).select("term").distinct().collect()
    assert len(runs) == 3


def test_rows_of_models_are_read_as_arrays_and_not_as_python_lists(spark):
    from gradeworks.operators import heads

    n = 300_000  # as lists, or by an expression a feature, the rows alone took most of a minute
    df = spark.range(0, n, 1, 4).select(F.col("id").alias("key"), F.array(*[F.pmod(F.col("id") * p, F.lit(101)).cast("double") for p in (3, 7, 11, 13)]).alias("x"), (F.col("id") % 17).cast("double").alias("y"), (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 3).cast("int").alias("inner"))
    phi = heads.fourier_features(df, "x", 4)
    assert "cos(" not in phi._jdf.queryExecution().optimizedPlan().toString().lower()
    start = monotonic()
    out = heads.kernel_ridge(df, "key", "x", 4, "y", "fold", "inner", 5)
    assert out.count() == n and monotonic() - start < 40
    i = np.arange(2000)
    x = np.column_stack([i * p % 101 for p in (3, 7, 11, 13)]).astype(float)
    small = df.where("key < 2000")
    got = heads.grams(small, "x", "y", "fold")
    for f in range(5):
        z = np.column_stack([np.ones(len(i)), x, i % 17])[i % 5 == f]
        assert np.allclose(got[f], z.T @ z)
    cv = heads.repeated_cv(small.withColumn("other", F.lit(None).cast("int")), "key", "x", "y", ["fold"], "inner", 5)
    assert cv.rows.where("oof is null or isnan(oof)").count() == 0
    blank = heads.repeated_cv(small, "key", "x", "y", ["fold"], "inner", 5, test=small.limit(9)).test
    assert blank.count() == 9


def test_runs_of_characters_are_numbered_by_arrays_and_a_digest_makes_no_row_of_a_term(spark, monkeypatch):
    words = ["a", "ab", "straße", "漢字", "😀x", "hello,", "zz", "a-b-c-d"]
    for given in (words, []):
        for low, high in ((2, 5), (4, 6), (1, 3), (3, 3)):
            names, flat, many = features.runs_of(pa.array(given, pa.string()), low, high)
            names, at = names.to_pylist(), 0
            assert len(set(names)) == len(names) and len(many) == len(given)
            for w, n in zip(given, many, strict=True):
                p = f" {w} "
                assert [names[k] for k in flat[at : at + n]] == [p[i : i + k] for k in range(low, high + 1) for i in range(max(len(p) - k + 1, 1))]
                at += n
    monkeypatch.setattr(features, "BLOCK_CHARS", 200)
    monkeypatch.setattr(features, "PLACES", 50)
    texts = [(1, "Straße a a-b, 漢字\x0bx"), (2, None), (3, "  "), (4, "hello hello, zz"), (4, "zz  ab"), (None, "ab zz a")] + [(i, f"zz w{i % 7} ab") for i in range(5, 60)]
    df = spark.createDataFrame(texts, "id long, text string")
    for how in ((features.word_terms, 2), (features.character_terms, 2, 40), (features.character_terms, 2)):
        long = {r.id: (r.n, r.top, r.total) for r in features.tfidf(df, "id", "text", *how).groupBy("id").agg(F.count("*").alias("n"), F.max("weight").alias("top"), F.sum("weight").alias("total")).collect()}
        short = {r.id: (r.terms, r.top, r.total) for r in features.tfidf(df, "id", "text", *how, digest=True).collect()}
        assert long.keys() == short.keys() and all(np.allclose(long[k], short[k], rtol=1e-12) for k in long)
    text = " ".join(f"{i * 7919 % 1000003:06d}{i:06d}" for i in range(150_000))  # 4.5 million places of runs, nearly all words different
    block = pa.table({"id": pa.array([1]), "text": pa.array([text])})
    made = features.character_terms(F.col("text"))
    start = monotonic()
    _, names, parts = features.counts(block, made.between, made.least, made.counted)
    assert sum(len(p[0]) for p in parts) == len(names) and monotonic() - start < 8


def test_blocks_of_a_matrix_are_small_and_not_held_in_memory(spark):
    cells = spark.range(1_200_000).select((F.col("id") % 3000).alias("r"), F.concat(F.lit("t"), F.floor(F.col("id") / 3000).cast("string")).alias("term"), F.lit(1.0).alias("weight"))
    blocks = features.blocks_of(cells)
    sizes = [r.n for r in blocks.select(F.size("weight").alias("n")).collect()]
    assert sum(sizes) == 1_200_000 and len(sizes) == 3 and max(sizes) < 600_000
    assert blocks.storageLevel.useDisk and not blocks.storageLevel.useMemory
    blocks.unpersist()

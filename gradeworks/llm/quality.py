"""Quality rules with adaptive thresholds (operator 5), in DataFrame functions only.

Every document is measured once, within its own row. For each language and
source the measures are counted in buckets whose edges grow by a constant factor:
a quantile sketch of half a per cent relative error. Sketches are merged by adding
counts, so the same documents give the same sketch in whatever order and
partitions they come. Quantiles of a pair, of its language and of all are taken
from the merged sketches; a pair's own count for as much as it has documents, its
language's for ``PRIOR`` documents more, and a language's likewise against those
of all. So small groups lean smoothly on larger ones.

A fence lies ``SPREADS`` times the distance from the median to an outer quantile
(rank 0.9, or 0.1 below) beyond that quantile: where a group's documents hardly
vary the fence is near them. There are no fixed cutoffs. What a share counts must
exceed the fence by a few occurrences (``SLACK``), as one symbol or one repeated
line says nothing. The measured rows are then filtered by a join with the fences.

Defined results: a null or blank text has no words and fails the base rules; a
null language or source is a group of its own; repeated rows are measured each
for themselves; a very long text is one row's work, linear in its length but for
the sort of its repeated windows; a value on a fence is inside; an empty table
gives no rows; further columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.llm.common import WORD, written

#: White space that parts words, and symbol characters.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Relative error of the sketches, and the factor between a bucket's edges that gives it.
ERROR = 0.005
GROWTH = math.log((1 + ERROR) / (1 - ERROR))
#: Documents that a larger group's quantiles count for, spreads beyond the outer quantiles, and their ranks.
PRIOR, SPREADS, RANKS = 100, 4.0, (0.1, 0.5, 0.9)
#: Shares: what is counted, of what, and the occurrences by which it must exceed the fence.
SHARES = {"symbol_share": ("n_symbols", "word_chars", 5), "dup_line_share": ("n_dup_lines", "n_lines", 5), "repeat_share": ("n_repeat_words", "n_words", 30)}
MEASURES = (*SHARES, "mean_word_chars")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The carried columns and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` of whole texts.

    Windows of three words are hashed to 64 bits and sorted with their place
    within the row, so repeats stand side by side. Only texts in which a window
    does repeat are sorted; nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(*carry, text.alias("__t")).select(*carry, "__t", F.transform(words(F.col("__t")), lambda w: F.xxhash64(w)).alias("__w"))
    n = F.size("__w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))).otherwise(
        F.array().cast("array<bigint>")
    )
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD))
    second = first.select(
        *carry,
        n.cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        windows.alias("__h"),
    )
    second = second.withColumns({"__d": F.array_distinct("__h"), "n_lines": F.size("__l").cast("long"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")})
    pairs = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    third = second.select(*carry, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.size("__d") < F.size("__h"), pairs).alias("__s"))
    same = lambda k, j: F.get("__s", k)["h"] == F.get("__s", j)["h"]
    repeated = F.filter(F.transform("__s", lambda x, k: F.when(F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)), x["i"])), lambda i: i.isNotNull())
    fourth = third.select(*carry, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.array_sort(repeated).alias("__p"))
    # words covered: a window that starts within three words of the one before adds that distance, any other adds three
    covered = F.aggregate(F.col("__p"), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(3))).alias("n"), p.alias("last")), lambda a: a["n"])
    return fourth.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def with_shares(rows: DataFrame) -> DataFrame:
    one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return rows.withColumns({**{name: F.col(count) / one(of) for name, (count, of, _) in SHARES.items()}, "mean_word_chars": F.col("word_chars") / one("n_words")})


def sketched(rows: DataFrame) -> DataFrame:
    """``lang, source, m, b, n``: documents of each pair in each bucket of each measure; zero has the least bucket. Counts combine before the shuffle."""
    bucket = lambda m: F.when(F.col(m) > 0, F.ceil(F.log(F.col(m)) / GROWTH).cast("int")).otherwise(F.lit(-(1 << 31)).cast("int"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), bucket(m).alias("b")) for i, m in enumerate(MEASURES)])).alias("x")
    return rows.select("lang", "source", each).groupBy("lang", "source", "x.m", "x.b").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, docs`` and an array of the values at ``RANKS`` for each measure, from sketches merged by ``keys``. A window has a group's buckets, whatever its documents."""
    merged = sketch.groupBy(*keys, "m", "b").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "m")
    cum = merged.withColumns({"below": F.sum("n").over(group.orderBy("b")), "docs": F.sum("n").over(group)})
    # the value that is off by the same factor from either edge of its bucket
    value = lambda b: F.when(b == -(1 << 31), 0.0).otherwise(F.exp(b * GROWTH) * (1 - ERROR))
    at = lambda i, r: value(F.min(F.when((F.col("m") == i) & (F.col("below") >= F.col("docs") * r), F.col("b"))))
    return cum.groupBy(*keys).agg(F.max("docs").alias("docs"), *[F.array(*[at(i, r) for r in RANKS]).alias(m) for i, m in enumerate(MEASURES)])


def fences(rows: DataFrame, prior: int = PRIOR, spreads: float = SPREADS) -> DataFrame:
    """``lang, source, low_*, high_*`` of each (language, source) pair, from merged sketches."""
    sketch = written(sketched(rows), "sketches")
    own, by_lang, of_all = quantiles(sketch, ["lang", "source"]), quantiles(sketch, ["lang"]), quantiles(sketch.withColumn("all", F.lit(0)), ["all"])
    named = lambda df, side: df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
    # the sketches of all are one row, and a language has one
    table = own.join(named(by_lang, "l"), F.col("lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(named(of_all, "a")), F.lit(True))
    lean = lambda near, docs, far: F.zip_with(near, far, lambda x, y: (x * docs + y * prior) / (docs + prior))
    out = [F.col("lang"), F.col("source")]
    for m in MEASURES:
        q = lean(F.col(m), F.col("docs"), lean(F.col(f"l_{m}"), F.col("l_docs"), F.col(f"a_{m}")))
        low, mid, high = (F.get(q, F.lit(i)) for i in range(3))
        # nearer values than its buckets are wide a sketch cannot tell apart
        far = lambda d, at: F.greatest(d, at * (2 * ERROR)) * spreads
        out += [(low - far(mid - low, low)).alias(f"low_{m}"), (high + far(high - mid, high)).alias(f"high_{m}")]
    return table.select(*out)


def judged(docs: DataFrame, least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document."""
    rows = written(measured(docs), "measures")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    shares = with_shares(rows).withColumn("base_failed", failed)
    table = written(fences(shares.where("not base_failed")), "fences").withColumnsRenamed({"lang": "__lang", "source": "__source"})
    at = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    within = F.col("mean_word_chars").between(F.col("low_mean_word_chars"), F.col("high_mean_word_chars"))
    for m, (count, of, slack) in SHARES.items():
        within &= F.col(count) <= F.col(f"high_{m}") * F.col(of) + slack
    return shares.join(table, at, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))

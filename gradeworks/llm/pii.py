"""Personal data by bootstrapped contextual extraction (operator 7), in DataFrame functions only.

Four kinds of base entities are found by patterns and checks. They are the
seeds: the words next to a seed are its lexical patterns. Patterns and instances
(identifier-like tokens that hold a digit or an at sign) form a weighted graph,
which is summed once over all documents. Rounds then score it: a pattern's
confidence for a kind is the share of its occurrences whose instance is believed
to be of that kind, an unseen instance is believed as far as its best accepted
pattern. Identifiers that nobody knows count against a pattern, so one that stands
beside many other things is not accepted. Patterns that end with enough confidence
and distinct support mark the unseen identifiers beside them.

Texts without a digit or an at sign hold no entity of any kind and are passed
by. Matches of
a kind are placed by splitting the text at them: a match starts after all the
pieces and matches before it. That running sum is a window over one document's
matches. The regular expressions start only where a run of their first
characters starts (or where the last match ended) and use possessive repeats,
which finds the same matches in time linear in the text and without recursion.

Defined results: a null or empty text has no spans; a very long text is one row's
work, in time that grows like sorting its tokens; of patterns that are equally
sure of an identifier the kind that is listed first wins; null and repeated ids are
kept as they come, each row for itself; an empty table gives no rows; further
columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.llm.common import dropped, written

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with starts and repeats that cannot run away.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Tokens that may be unseen identifiers.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
BYTE_PART = r"^0*+(?:[0-9]?|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
#: Rounds of scoring, and what makes a pattern count.
ROUNDS, LEAST_CONFIDENCE, LEAST_SUPPORT = 3, 0.6, 5


def luhn(digits: Column) -> Column:
    """Whether a digit string of bounded length passes the Luhn check."""
    turned = F.reverse(digits)
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    ip = F.forall(F.split(hit, r"\."), lambda x: x.rlike(BYTE_PART))
    card = F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    return F.when(kind == 1, ip).when(kind == 2, card).when(kind == 3, n.between(9, 15)).otherwise(True)


def matches(texts: DataFrame) -> DataFrame:
    """Rows ``uid, kind, start, end, hit, left, right`` of the four kinds (0-3, valid ones) and of candidates (4).

    ``left`` and ``right`` are the lower-cased words beside the match, empty at the text's ends.
    """
    each = [
        F.struct(F.lit(k).alias("kind"), F.split("text", p, -1).alias("pieces"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("hits")) for k, p in enumerate((*PATTERNS, CANDIDATE))
    ]
    kinds = texts.select("uid", F.explode(F.array(*each)).alias("m")).where(F.size("m.hits") > 0)
    first_word = lambda c: F.lower(F.regexp_extract(c, r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1))
    rows = kinds.select("uid", "m.kind", F.posexplode(F.arrays_zip(F.col("m.pieces").alias("piece"), F.col("m.hits").alias("hit"), F.expr("slice(m.pieces, 2, size(m.pieces))").alias("next")))).where(
        "col.hit is not null"
    )
    rows = rows.select(
        "uid", "kind", "pos", F.length("col.piece").cast("long").alias("gap"), F.length("col.hit").cast("long").alias("n"), F.col("col.hit").alias("hit"),
        F.reverse(first_word(F.reverse("col.piece"))).alias("left"), first_word(F.col("col.next")).alias("right"),
    )
    before = Window.partitionBy("uid", "kind").orderBy("pos")
    start = F.sum(F.col("gap") + F.col("n")).over(before) - F.col("n")
    placed = rows.select("uid", "kind", start.alias("start"), (start + F.col("n")).alias("end"), "hit", "left", "right")
    return placed.where(valid(F.col("kind"), F.col("hit")))


def apart(found: DataFrame) -> DataFrame:
    """The base matches, and those candidates that overlap none of them."""
    along = Window.partitionBy("uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    # what comes later is what came before in the other direction: a running minimum, where a frame to the end would be made anew for each row
    back = Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("kind") < 4
    reached = F.max(F.when(base, F.col("end"))).over(along)
    coming = F.min(F.when(base, F.col("start"))).over(back)
    free = ~F.coalesce(reached > F.col("start"), F.lit(False)) & ~F.coalesce(coming < F.col("end"), F.lit(False))
    return found.withColumn("free", base | free).where("free").drop("free")


def patterns_of(rows: DataFrame) -> DataFrame:
    """One row for each side of a match that has a word: ``pattern`` is the side and the word."""
    sides = F.array(F.when(F.col("left") != "", F.concat(F.lit("<"), "left")), F.when(F.col("right") != "", F.concat(F.lit(">"), "right")))
    return rows.withColumn("pattern", F.explode(sides)).where("pattern is not null")


def learned(rows: DataFrame, rounds: int = ROUNDS, confidence: float = LEAST_CONFIDENCE, support: int = LEAST_SUPPORT) -> DataFrame:
    """Accepted patterns ``pattern, as_kind, confidence`` after rounds of scoring the pattern-instance graph."""
    seen = F.when(F.col("kind") < 4, F.col("kind"))
    graph = written(patterns_of(rows).groupBy("pattern", F.lower("hit").alias("instance"), seen.alias("seed")).agg(F.count("*").alias("n")), "pattern-graph")
    seeds = graph.where("seed is not null").select("pattern", "instance", F.col("seed").alias("as_kind"), F.col("n").cast("double").alias("mass"))
    totals = graph.groupBy("pattern").agg(F.sum("n").alias("total"))
    open_edges = graph.where("seed is null").select("pattern", "instance", "n")
    accepted = None
    for k in range(rounds):
        if accepted is None:
            mass = seeds
        else:
            belief = open_edges.join(accepted.select("pattern", "as_kind", "confidence"), "pattern").groupBy("instance", "as_kind").agg(F.max("confidence").alias("belief"))
            told = open_edges.join(belief, "instance").select("pattern", "instance", "as_kind", (F.col("n") * F.col("belief")).alias("mass"))
            mass = seeds.union(told)
        by_instance = mass.groupBy("pattern", "as_kind", "instance").agg(F.sum("mass").alias("mass"))
        scored = by_instance.groupBy("pattern", "as_kind").agg(F.sum("mass").alias("mass"), F.count("*").alias("support")).join(totals, "pattern")
        scored = scored.withColumn("confidence", F.col("mass") / F.col("total")).where((F.col("confidence") >= confidence) & (F.col("support") >= support))
        after = written(scored.select("pattern", "as_kind", "confidence"), f"patterns-{k}")
        if accepted is not None:
            dropped(accepted)
        accepted = after
    return accepted


def extracted(docs: DataFrame, **how) -> DataFrame:
    """Each document with its base spans and all spans: ``doc_id, base, spans``.

    Both are arrays of ``(start, kind, end)`` sorted by start and kind, null
    where a text has none. Starts and ends count code points, ends are exclusive.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).alias("text"))
    # row numbers are given once and written, so that every later plan sees the same
    held = written(marked.withColumn("uid", F.monotonically_increasing_id()), "texts-that-may-match")
    found = written(matches(held.where("text is not null")), "matches")
    rows = written(apart(found), "apart")
    dropped(found)
    accepted = learned(rows, **how)
    told = patterns_of(rows.where("kind = 4")).join(accepted, "pattern")
    best = told.groupBy("uid", "start", "end").agg(F.max(F.struct("confidence", (-F.col("as_kind")).alias("k"))).alias("b"))
    new = best.select("uid", "start", (-F.col("b.k")).cast("int").alias("kind"), "end", F.lit(False).alias("base"))
    spans = rows.where("kind < 4").select("uid", "start", "kind", "end", F.lit(True).alias("base")).union(new)
    span = F.struct("start", "kind", "end")
    by_text = spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    return held.select("uid", "doc_id").join(by_text, "uid", "left").select("doc_id", "base", "spans")


def written_out(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

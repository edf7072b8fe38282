"""Fuzzy line dedup (operator 1), in DataFrame functions only.

Lines are normalised (lower case, single spaces) and equal ones become one node.
Nodes get a 64-bit SimHash of their distinct words. Fingerprints are cut into m
blocks: two that differ in at most three bits agree in at least m - 3 of them,
so a node stands in the bucket of each choice of m - 3 blocks and meets every
node that near in one of them. m grows slowly with the number of nodes, so that
strangers seldom meet; it changes the work, not the pairs. Pairs are verified by
edit similarity, links form groups, and of each group's occurrences the first
(least document id, then place) is kept.

With ``pieces`` the search is wider: lines also meet by a piece of their own
words, which an edit elsewhere leaves as it is, lines of eight words or more by
what they start and end with, shorter ones by what is left without one word. Of
those the fingerprints may differ in up to ``REACH`` bits. All candidates are
within the lengths that the similarity allows. None of these bounds changes with
the size of the table. How a bucket is searched without comparing all its pairs
is told in ``common.same_group``; of a large
bucket what is left then meets slice by slice (``wide_links``).

Defined results: null and blank texts have no lines; lines without a word are
kept and not counted; a null id comes before all others; rows that repeat an id
hold the same occurrences and keep or lose them together; an empty table gives
no rows; a very long line is compared whole, a very long text is its lines; further
columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import SMALL_BUCKET, dropped, fresh, hamming, released, same_group, written

BITS = 3
SIMILARITY = 0.8
#: Bits within which two lines that share a piece are candidates.
REACH = 18
#: Words from which a line is met by its start and its end, each a quarter to a half of it.
PIECED = 8
#: Four counters of 16 bits in a long; no sum of so many hashes overflows one.
LANES, COUNTED = 0x0001000100010001, 16_383
#: Runs of white space other than a single space. Such runs are rare, so lines are first searched for what each of them holds.
WIDE_GAP = r"[\x09-\x0D\x20](?:(?<!\x20)[\x09-\x0D\x20]*|[\x09-\x0D\x20]+)"
#: Characters that stand for words while two lines are compared: the first one's code point, and how many words they serve.
CODES = (0x3400, 20_000)
#: Edits that are tried before those allowed; characters from which lines that are mostly unlike are compared by words before.
BANDS, CODED_FROM = (32, 256), 2_000
#: Lines and their code points in a slice of a large bucket, and tasks that compare slices at most.
SLICE_ROWS, SLICE_CHARS, MOST_TASKS = 128, 49_152, 4_096
#: Candidate nodes up to this number are broadcast to fetch their lines; beyond it they are joined by a shuffle.
BROADCAST_KEYS = 400_000


def lines_of(docs: DataFrame) -> DataFrame:
    """``uid, doc_id, th, pos, key, norm, words`` of every line; key is null for lines without a word."""
    text = F.lower(F.coalesce("text", F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("th"), text.alias("text"))
    each = rows.select("uid", "doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    wide = reduce(lambda x, y: x | y, [F.contains("line", F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")])
    norm = F.trim(F.when(wide, F.regexp_replace("line", WIDE_GAP, " ")).otherwise(F.col("line")))
    each = each.select("uid", "doc_id", "th", "pos", norm.alias("norm"))
    words = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    return each.select("uid", "doc_id", "th", "pos", F.when(F.col("norm") != "", F.xxhash64("norm")).alias("key"), "norm", words.alias("words"))


def simhashed(lines: DataFrame) -> DataFrame:
    """``key, fp, len`` of the distinct lines; len counts code points.

    A hash is counted bit by bit in sixteen longs of four 16-bit counters, for
    each line by itself and before anything is shuffled. Lines with more words
    than such a counter holds are counted in 64 sums; they are rare, and the
    scan for them passes by what holds none.
    """
    rows = lines.where("key is not null").select("key", "words", F.monotonically_increasing_id().alias("line"), "norm", F.length("norm").cast("long").alias("len"))
    hashed = lambda df: df.select("key", "line", "len", F.explode(F.array_distinct(F.split("norm", " "))).alias("w")).select("key", "line", "len", F.xxhash64("w").alias("h"))
    packed = hashed(rows.where(F.col("words") <= COUNTED)).groupBy("key", "line").agg(*[F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(LANES))).alias(f"s{b}") for b in range(16)], F.count("*").alias("n"), F.first("len").alias("len"))
    wide = hashed(rows.where(F.col("words") > COUNTED)).groupBy("key", "line").agg(*[F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"c{b}") for b in range(64)], F.count("*").alias("n"), F.first("len").alias("len"))
    # a counter above half of n reaches bit 14 once what half of n lacks to that is added, for four counters at once
    lack = (COUNTED - F.floor(F.col("n") / 2)) * LANES
    ones = [F.shiftleft(F.shiftrightunsigned(F.col(f"s{b}") + F.col("lack"), 14).bitwiseAND(F.lit(LANES)), b) for b in range(16)]
    either = lambda xs: reduce(lambda x, y: x.bitwiseOR(y), xs)
    short = packed.withColumn("lack", lack).select("key", either(ones).alias("fp"), "len")
    bits = [F.when(F.col(f"c{b}") * 2 > F.col("n"), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(F.lit(0)) for b in range(64)]
    return short.union(wide.select("key", either(bits).alias("fp"), "len")).groupBy("key").agg(F.first("fp").alias("fp"), F.first("len").alias("len"))


def pieced(lines: DataFrame) -> DataFrame:
    """``bucket, key``: the hashes of each line's pieces, again for each line that is equal."""
    norm, n, h = F.col("norm"), F.col("n"), F.col("h")
    rows = lines.where("key is not null").select("key", "norm", F.col("words").alias("n"))
    # the runs double with the line; from the last length on they no longer grow
    level = F.lit(0)
    for k in (PIECED // 2 << k for k in range(12)):
        level = F.when(n >= 2 * k, k).otherwise(level)
    rows = rows.select("key", "norm", "n", level.alias("h"))
    part = lambda k: F.call_function("substring_index", norm, F.lit(" "), k)
    run = lambda side, h: F.xxhash64(F.lit(side), h, part(h * side))
    without = lambda j: F.when(n > j, F.xxhash64(F.trim(F.concat(part(F.lit(j)), F.lit(" "), part(F.lit(j + 1) - n)))))
    half = (h / 2).cast("int")
    # a line of little more than the level's words also meets those that fall just short of it
    lower = lambda side: F.when((h >= PIECED) & (n * 2 < h * 5), run(side, half))
    most = PIECED + 2
    own = F.when(n < 2, F.array().cast("array<bigint>")).when(n < most, F.array(F.xxhash64("norm"), *map(without, range(most - 1)), *[F.when(h > 0, run(side, h)) for side in (1, -1)]))
    return rows.select(F.explode(own.otherwise(F.array(run(1, h), run(-1, h), lower(1), lower(-1)))).alias("bucket"), "key").where("bucket is not null")


def n_blocks(nodes: int, bits: int = BITS) -> int:
    """Blocks to cut into: the more nodes, the more bits a bucket fixes, so that strangers seldom share one."""
    m = bits + 2
    while 64 * (m - bits) / m < math.log2(max(nodes, 1)) + 4 and m < 4 * bits:
        m += 1
    return m


def bucket_keys(fp: Column, bits: int, blocks: int) -> list[Column]:
    """One long for each choice of ``blocks - bits`` blocks, holding their bits and which choice it is."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for chosen in combinations(range(blocks), blocks - bits):
        mask = sum((1 << cut[i + 1]) - (1 << cut[i]) for i in chosen)
        mask -= 1 << 64 if mask >> 63 else 0
        out.append(F.xxhash64(F.lit(len(out)), fp.bitwiseAND(F.lit(mask))))
    return out


def few(table: DataFrame) -> DataFrame:
    """A table to broadcast where it was counted to be short, else as it is."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def alike(a: Column, b: Column) -> Column:
    """How many words two lists start with alike."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return bound(other, lambda at: F.when(at > 0, at.cast("int") - 1).otherwise(F.size(a)))


def similar(a: Column, b: Column, allowed: Column, bands: tuple[int, ...] = BANDS, coded_from: int = 0) -> Column:
    """Whether the lines of two lists of words are within so many edits.

    Words that both lines start or end with go first, which leaves the distance
    as it is. What the words in between would cost to replace one by one, or as
    a whole, bounds the distance from above and settles most pairs; the others
    get their distance, within narrow bands before the widest that is allowed.
    """
    within = lambda x, y, t: F.call_function("levenshtein", x, y, t) >= 0
    words = lambda c: F.aggregate(F.zip_with(c["a"], c["b"], lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.length(x), F.length(y)))), F.lit(0), lambda s, w: s + w)
    # no edit of whole words costs more than the longest of them and a space, so their number bounds the distance too
    longest = lambda kinds: F.array_max(F.transform(kinds, lambda w: F.length(w))) + 1
    coded = lambda c, kinds, one: F.array_join(F.transform(c, lambda w: one(F.array_position(kinds, w))), "")
    wide = lambda k: F.decode(F.unhex(F.hex(k + CODES[0])), "UTF-16BE")

    def by_words(c: Column) -> Column:
        alike_in = lambda kinds, one: bound(F.floor(allowed / longest(kinds)).cast("int"), lambda t: (t > 0) & within(coded(c["a"], kinds, one), coded(c["b"], kinds, one), t))
        few_kinds = lambda kinds: F.when(F.size(kinds) < 256, alike_in(kinds, F.char)).when(F.size(kinds) < CODES[1], alike_in(kinds, wide)).otherwise(False)
        return bound(F.array_distinct(F.concat(c["a"], c["b"])), few_kinds)

    def decided_by(c: Column) -> Column:
        x, y, n, m = c["x"], c["y"], c["n"], c["m"]
        whole = F.greatest(n, m) + F.when((n == 0) | (m == 0), 1).otherwise(0)  # a run that only one line has brings its space along
        near = F.when(whole <= allowed, True).when((n == 0) | (m == 0), False).when((F.size(c["a"]) == F.size(c["b"])) & (words(c) <= allowed), True)
        near = near.when((F.greatest(n, m) >= coded_from) & by_words(c), True)
        for band in bands:
            near = near.when(within(x, y, F.least(allowed, F.lit(band))), True).when(allowed <= band, False)
        return near.otherwise(within(x, y, allowed))

    def cores(e: Column) -> Column:
        cut = lambda w: F.slice(w, e["p"] + 1, F.size(w) - e["p"] - F.least(e["q"], F.least(F.size(a), F.size(b)) - e["p"]))
        joined = lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.array_join(c["a"], " ").alias("x"), F.array_join(c["b"], " ").alias("y"))
        counted = lambda c: F.struct(*[c[f].alias(f) for f in "abxy"], F.length(c["x"]).alias("n"), F.length(c["y"]).alias("m"))
        return bound(F.struct(cut(a).alias("a"), cut(b).alias("b")), lambda c: bound(joined(c), lambda c: bound(counted(c), decided_by)))

    return bound(F.struct(alike(a, b).alias("p"), alike(F.reverse(a), F.reverse(b)).alias("q")), cores)


def most_edits(n: Column, m: Column, similarity: float) -> Column:
    return F.floor(F.greatest(n, m) * (1 - similarity) + 1e-9).cast("int")


def texts_of(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """``key, norm`` of those nodes."""
    keys = written(keys.distinct(), "line-keys")
    out = written(lines.select("key", "norm").join(few(keys), "key", "left_semi").groupBy("key").agg(F.first("norm").alias("norm")), "line-texts")
    dropped(keys)
    return out


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those pairs ``u, v`` of nodes whose normalised lines are similar."""
    pairs = written(pairs.distinct(), "line-pairs")
    side = lambda c, text: few(pairs).join(texts.select(F.col("key").alias(c), F.col("norm").alias(text)), c)
    both = side("u", "x").join(side("v", "y"), ["u", "v"]).withColumns({"n": F.length("x"), "m": F.length("y")})
    allowed = most_edits(F.col("n"), F.col("m"), similarity)
    both = both.where(F.abs(F.col("n") - F.col("m")) <= allowed).withColumns({"a": F.split("x", " "), "b": F.split("y", " ")})
    out = written(both.where(similar(F.col("a"), F.col("b"), allowed)).select("u", "v"), "line-links")
    dropped(pairs)
    return out


def wide_links(told: DataFrame, texts: DataFrame, near: Callable, bits: int, similarity: float) -> DataFrame:
    """Links ``u, v`` between the groups ``g`` of large buckets: slices of bounded size meet two by two, and only links leave a task.

    Lines are read once a slice, not once a pair, and nothing is kept of pairs
    that are not similar. A pair that shares several pieces is looked at in one.
    """
    homes = told.where(F.col("reach") > bits).groupBy("node").agg(F.collect_set("bucket").alias("homes"))
    many = F.ceil(F.greatest(F.sum("len") / SLICE_CHARS, F.count("*") / SLICE_ROWS)).cast("int")
    cut = told.join(told.groupBy("bucket").agg(many.alias("many")), "bucket").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    cut = cut.join(homes, "node", "left").join(texts.withColumnRenamed("key", "node"), "node")
    columns = ("node", "g", "fp", "len", "reach", "norm")
    slices = cut.groupBy("bucket", "many", "slice").agg(F.collect_list(F.struct(*columns, F.coalesce("homes", F.array().cast("array<bigint>")).alias("homes"))).alias("side"))
    slices = written(slices, "line-slices")
    upper = slices.select("bucket", F.col("slice").alias("i"), F.explode(F.sequence("slice", F.col("many") - 1)).alias("j"), F.col("side").alias("a"))
    lower = slices.select("bucket", F.explode(F.sequence(F.lit(0), "slice")).alias("i"), F.col("slice").alias("j"), F.col("side").alias("b"))
    # few bytes are much work here, so their size must not say how many tasks there are
    tasks = min(max(1, upper.count()), MOST_TASKS)
    met = upper.repartition(tasks, "bucket", "i", "j").join(lower.repartition(tasks, "bucket", "i", "j"), ["bucket", "i", "j"])

    # most of these pairs are not similar, for which narrow bounds are lost work
    def link(x: Column, y: Column) -> Column:
        here = F.when(x["reach"] > bits, F.array_min(F.array_intersect(x["homes"], y["homes"])) == F.col("bucket")).otherwise(~F.arrays_overlap(x["homes"], y["homes"]))
        once = (F.col("i") < F.col("j")) | (x["node"] < y["node"])
        return once & (x["g"] != y["g"]) & near(x, y) & here & similar(x["words"], y["words"], most_edits(x["len"], y["len"], similarity), BANDS[1:], CODED_FROM)

    cut_up = lambda side: F.transform(side, lambda x: F.struct(*[x[c].alias(c) for c in (*columns[:-1], "homes")], F.split(x["norm"], " ").alias("words")))
    ends = lambda x, y: F.struct(F.least(x["g"], y["g"]).alias("u"), F.greatest(x["g"], y["g"]).alias("v"))
    links = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: link(x, y)), lambda y: ends(x, y))))
    found = bound(cut_up(F.col("a")), lambda a: bound(cut_up(F.col("b")), lambda b: F.array_distinct(links(a, b))))
    out = written(met.select(F.explode(found).alias("e")).select("e.u", "e.v").distinct(), "line-wide-links")
    released(told.sparkSession)
    dropped(slices)
    return out


def with_near(members: DataFrame, near: Callable) -> DataFrame:
    """``members`` without those of a small bucket that are near none of it, which strangers in a bucket mostly are."""
    members = written(members, "line-met")
    columns = [c for c in members.columns if c not in ("bucket", "n")]
    small = members.where(F.col("n") <= SMALL_BUCKET).groupBy("bucket").agg(F.collect_list(F.struct(*columns)).alias("all"))
    some = F.filter("all", lambda x: F.exists("all", lambda y: (x["node"] != y["node"]) & near(x, y)))
    out = small.select("bucket", F.explode(some).alias("x")).select("bucket", *[F.col(f"x.{c}").alias(c) for c in columns])
    out = written(out.union(members.where(F.col("n") > SMALL_BUCKET).select("bucket", *columns)), "line-near")
    dropped(members)
    return out


def grouped(lines: DataFrame, bits: int = BITS, similarity: float = SIMILARITY, pieces: bool = False) -> DataFrame:
    """``id, component`` of the nodes that have a link."""
    fps = written(simhashed(lines), "line-fingerprints")
    blocks = n_blocks(fps.count(), bits)
    stood = fps.select("key", "fp", F.explode(F.array(*bucket_keys(F.col("fp"), bits, blocks))).alias("bucket"))
    if pieces:
        released(lines.sparkSession)
        shared = pieced(lines).groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        shared = written(shared.where("least < most").select("bucket", "n"), "line-pieces")
        released(lines.sparkSession)
    # of two in a bucket, the exclusive or of their fingerprints is what they differ in
    buckets = stood.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("fp").alias("x"), F.min("key").alias("least"), F.max("key").alias("most"))
    buckets = written(buckets.where((F.col("n") > 2) | (F.col("n") == 2) & (F.bit_count("x") <= bits)), "line-buckets")
    released(lines.sparkSession)
    pairs = buckets.where("n = 2").select(F.col("least").alias("u"), F.col("most").alias("v"))
    members = stood.join(few(buckets.where("n > 2").select("bucket", "n")), "bucket").select("bucket", F.col("key").alias("node"), F.lit(bits).cast("long").alias("reach"), "n")
    if pieces:
        met = pieced(lines).join(few(shared), "bucket").select("bucket", F.col("key").alias("node"), F.lit(REACH).cast("long").alias("reach"), "n")
        members = members.union(met.distinct())

    def near(a: dict[str, Column], b: dict[str, Column]) -> Column:
        length = F.abs(a["len"] - b["len"]) <= F.greatest(a["len"], b["len"]) * (1 - similarity) + 1e-9
        return length & (hamming(a["fp"], b["fp"]) <= a["reach"])

    members = with_near(members.join(fps.withColumnRenamed("key", "node"), "node").select("bucket", "node", "fp", "len", "reach", "n"), near)
    texts = texts_of(members.select(F.col("node").alias("key")).union(pairs.select("u")).union(pairs.select("v")), lines)
    labels = same_group(members, near, lambda found: verified(found, texts, similarity), "line", pairs, wide=lambda told: wide_links(told, texts, near, bits, similarity))
    for t in (fps, buckets, members, texts):
        dropped(t)
    return labels


def decided(docs: DataFrame, bits: int = BITS, similarity: float = SIMILARITY, pieces: bool = False) -> DataFrame:
    """One row per document: ``doc_id, th, n_lines, n_dropped, dropped`` (places of the lines to drop, sorted)."""
    lines = written(lines_of(docs), "lines")
    groups = written(grouped(lines, bits, similarity, pieces), "line-components")
    occurrences = lines.select("uid", "doc_id", "th", "pos", "key")
    place = F.struct("doc_id", "pos")
    # a line that occurs once and has no group stays, so only the others are grouped again
    each = occurrences.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("keep"))
    each = each.join(few(groups), F.col("key") == F.col("id"), "left").where("n > 1 or component is not null").select("key", F.coalesce("component", "key").alias("g"), "n", "keep")
    each = written(each, "line-occurrences")
    keepers = each.groupBy("g").agg(F.sum("n").alias("n"), F.min("keep").alias("keep")).where("n > 1").select("g", "keep")
    keepers = written(each.select("key", "g").join(keepers, "g").select("key", "keep"), "line-keepers")
    drop = F.col("keep").isNotNull() & ~place.eqNullSafe(F.col("keep"))
    judged = occurrences.where("key is not null").join(few(keepers), "key", "left").select("uid", "doc_id", "th", F.when(drop, F.col("pos")).alias("pos"), F.lit(1).alias("line"))
    blank = occurrences.where("key is null").select("uid", "doc_id", "th", F.lit(None).cast("int").alias("pos"), F.lit(0).alias("line"))
    out = judged.union(blank).groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.sum("line").alias("n_lines"), F.sort_array(F.collect_list("pos")).alias("dropped"))
    return out.select("doc_id", "th", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents with their own columns, ``text`` without the dropped lines."""
    ident, th, places = fresh(docs, "dropped_id", "dropped_th", "dropped_places")
    by = decided(docs, **how).where("n_dropped > 0").dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias(ident), F.col("th").alias(th), F.col("dropped").alias(places))
    at = F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(th))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(places, i))
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return docs.join(by, at, "left").select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])

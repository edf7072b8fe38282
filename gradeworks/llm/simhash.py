"""SimHash near-dedup with vantage-point trees (operator 6).

A text's fingerprint is the majority of its 4-word shingles' 64-bit hashes, bit
by bit. Fingerprints that differ in few bits are linked. The distinct
fingerprints are partitioned by a vantage-point tree over a bounded sample:
each has one home shard, and is also sent, as a query, to every shard that the
triangle bound leaves open. A shard finds its exact pairs by a vantage-point
join: members and queries descend together, and branches that cannot hold a
pair are pruned. A shard returns a spanning forest of its pairs, so the links
of a group of k fingerprints are fewer than k there, and components are then
found over all shards.

Random 64-bit fingerprints lie at distances 32 +- 4 from any vantage point, so
a cut with a bound of 4 bits sends about two thirds of the rows both ways. The
replication at depth d is near 1.68 ** d, and a fingerprint meets about
n ** 0.75 others. That is the price of the method; the depth only grows with the
number of distinct fingerprints, to keep a shard in memory.

Near copies by a word-shingle similarity (``similar_groups``) are first met the same way,
as pairs that the trees link, and the exact similarity decides. Others lie further apart: at
a Jaccard similarity of 0.8 of five-word shingles, fingerprints differ in 10 +- 3
bits, a bound at which the triangle inequality prunes nothing (13 bits either way
of 32 +- 4). Those candidates come from 36 bands of seven MinHashes instead, which
meet a pair at 0.8 with probability 0.9998 and more above. Of them stay
those whose fingerprints are within ``REACH`` bits, whose sizes allow the
similarity, and whose MinHashes differ in the lowest bit no oftener than
``UNLIKE`` times (at 0.8 that is 25 +- 5 of 252); the exact similarity of the
whole texts decides. How a bucket is searched without comparing all its
pairs is told in ``common.same_group``. What is left of a large bucket is compared
slice by slice, and a task returns a spanning forest of its links.

Defined results: null, empty and blank texts have fingerprint zero, linked like
any other (by similarity they are one group, the empty set); very long texts are
read in blocks; equal rows have equal fingerprints and so one component; a
component's id is the least id in it that is not null (null if there is none); an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import components, dropped, fresh, hamming, same_group, written

SHINGLE = 4
SEED = 42
BITS = 4
#: Distinct fingerprints that a home shard is meant to hold at most, beyond the least depth.
SHARD_ROWS = 1 << 20
LEAST_DEPTH = 5
#: Fingerprints that the partitioning tree is built from.
TREE_SAMPLE = 4096
LEAF = 256
BLOCK = 1 << 16
#: Near copies by similarity: words of a shingle, least Jaccard similarity, bands and MinHashes of a band, bits that fingerprints may differ in, and lowest bits of MinHashes.
NEAR_SHINGLE, SIMILARITY, BANDS, ROWS, REACH, UNLIKE = 5, 0.8, 36, 7, 20, 42
MINHASH_BLOCK = 1 << 10
#: Shingles and rows of a slice of a large bucket, about: a task holds two slices.
SLICE_PARTS, SLICE_ROWS = 1 << 21, 2048
_RNG = np.random.default_rng(20)
#: Odd factors and offsets of the MinHashes.
FACTORS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    a, b = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(a[at : at + BLOCK], b[at : at + BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, th, fp``: th tells rows of one id apart by their text, fp is the fingerprint as a signed long."""

    def work(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, th long, fp long")


def grown(sample: np.ndarray, depth: int, rng: np.random.Generator):
    """A vantage-point tree as nested tuples (vantage, radius, inner, outer); None is a leaf."""
    if depth == 0 or len(sample) < 2:
        return None
    vantage = sample[rng.integers(len(sample))]
    d = np.bitwise_count(sample ^ vantage)
    radius = int(np.median(d))
    if (d <= radius).all():
        radius -= 1
    if radius < 0:
        return None
    return vantage, radius, grown(sample[d <= radius], depth - 1, rng), grown(sample[d > radius], depth - 1, rng)


def routed(tree, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, fingerprint, whether that shard is its home) for all shards that the triangle bound leaves open."""
    out, leaf = [], 0

    def walk(node, rows, home):
        nonlocal leaf
        if node is None:
            out.append((np.full(len(rows), leaf, dtype=np.int32), rows, home))
            leaf += 1
            return
        vantage, radius, inner, outer = node
        d = np.bitwise_count(rows ^ vantage).astype(np.int16)
        near, far = d <= radius + bits, d > radius - bits
        walk(inner, rows[near], home[near] & (d[near] <= radius))
        walk(outer, rows[far], home[far] & (d[far] > radius))

    walk(tree, fps, np.ones(len(fps), dtype=bool))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least index of each index's component under links u-v."""
    least = np.arange(n)
    while True:
        a, b = least[u], least[v]
        m = np.minimum(a, b)
        np.minimum.at(least, a, m)
        np.minimum.at(least, b, m)
        while True:
            deeper = least[least]
            if (deeper == least).all():
                break
            least = deeper
        if (least[u] == least[v]).all():
            return least


def joined(fps: np.ndarray, home: np.ndarray, bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs between home members and all rows of a shard, by a vantage-point join."""
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    rng = np.random.default_rng(seed)
    least = np.arange(len(fps))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    stack = [(np.flatnonzero(home), np.arange(len(fps)))]
    while stack:
        members, asked = stack.pop()
        if not len(members) or not len(asked):
            continue
        if len(members) > LEAF:
            vantage = fps[members[rng.integers(len(members))]]
            d = np.bitwise_count(fps[members] ^ vantage).astype(np.int16)
            radius = int(np.median(d))
            if (d <= radius).all():
                radius -= 1
            e = np.bitwise_count(fps[asked] ^ vantage).astype(np.int16)
            inner = d <= radius
            stack.append((members[inner], asked[e <= radius + bits]))
            stack.append((members[~inner], asked[e > radius - bits]))
            continue
        step = (1 << 20) // len(members)
        for at in range(0, len(asked), step):
            q = asked[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fps[q][:, None] ^ fps[members][None, :]) <= bits)
            u, v = q[i], members[j]
            some = least[u] != least[v]
            if some.any():
                found.append((u[some], v[some]))
                held += int(some.sum())
        if held > 1 << 21:  # what is found so far becomes a forest, so memory stays bounded
            least = forest(*(np.concatenate(x) for x in zip((np.arange(len(fps)), least), *found, strict=True)), len(fps))
            found, held = [], 0
    if found:
        least = forest(*(np.concatenate(x) for x in zip((np.arange(len(fps)), least), *found, strict=True)), len(fps))
    tied = np.flatnonzero(least != np.arange(len(fps)))
    return fps[least[tied]], fps[tied]


def linked(fps: DataFrame, bits: int = BITS, shard_rows: int = SHARD_ROWS, least_depth: int = LEAST_DEPTH) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp``, enough to connect all that differ in at most ``bits`` bits."""
    n = fps.count()
    depth = max(least_depth, math.ceil(math.log2(max(n, 1) / shard_rows)))
    keep = min(1.0, TREE_SAMPLE / max(n, 1))
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(keep * (1 << 30))).toArrow().column("fp").to_numpy()
    tree = grown(np.sort(sample).view(np.uint64), depth, np.random.default_rng(1)) if n else None

    def route(batches):
        for b in batches:
            shard, fp, home = routed(tree, b.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp.view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        u, v = joined(part["fp"].to_numpy().view(np.uint64), part["home"].to_numpy(), bits)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    # a set number of partitions, so that few bytes a shard do not put all shards into one task
    sent = fps.mapInArrow(route, "shard int, fp long, home boolean").repartition(4 << depth, "shard")
    return sent.groupBy("shard").applyInPandas(pairs, "u long, v long")


def grouped(docs: DataFrame, bits: int = BITS, **shape) -> DataFrame:
    """``doc_id, th, fp, component, component_id`` for every document.

    ``component`` is the least fingerprint of the group, which names it even
    where ids repeat or are missing.
    """
    rows = written(fingerprinted(docs), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = components(linked(fps.select("fp"), bits, **shape), "simhash")
    groups = written(fps.join(found, fps.fp == found.id, "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "groups")
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = written(groups.join(least, "component").select("fp", "component", "component_id"), "component-ids")
    return rows.join(ids, "fp").select("doc_id", "th", "fp", "component", "component_id")


def shingles(text: str | None, size: int = NEAR_SHINGLE) -> set[bytes]:
    """The distinct shingles of a whole text; a shorter text is one shingle, one without words has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similar(a: str | None, b: str | None, least: float = SIMILARITY) -> bool:
    x, y = shingles(a), shingles(b)
    return len(x & y) >= least * len(x | y) - 1e-9


def similar_parts(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """The same from 64-bit hashes of the distinct shingles."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def sketched(text: str | None) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """(hash of the text's words, fingerprint of its distinct shingles, their number, a hash for each band of MinHashes, their lowest bits in four longs)."""
    words = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    parts = shingles(text)
    node = xxhash.xxh64_intdigest(words, SEED)
    if not parts:
        return node, 0, 0, np.zeros(0, dtype=np.int64), np.zeros(4, dtype=np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(p) for p in parts), dtype=np.uint64, count=len(parts))
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), MINHASH_BLOCK):
        block = h[at : at + MINHASH_BLOCK]
        x = block[:, None] * FACTORS + OFFSETS
        # the low bits of a product hang on low bits only
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp = int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])
    bands = np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64)
    # a bit of the hash of a MinHash: its own lowest bit hangs on the shingle's lowest bit alone
    low = np.packbits(((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.uint8) & 1, bitorder="little")
    return node, fp, len(h), bands.view(np.int64), low.view("<i8")


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, th, node, mark, fp, size, bands, low0...low3`` of every document; mark is the fingerprint that ``grouped`` goes by."""
    lows = [f"low{k}" for k in range(4)]

    def work(batches):
        for b in batches:
            node, fp, size, bands, low = zip(*(sketched(t.as_py()) for t in b.column(2)), strict=True) if b.num_rows else [()] * 5
            low = np.array(low, dtype=np.int64).reshape(-1, 4)
            marks = [fingerprint(t.as_py()) for t in b.column(2)]
            signed = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (node, marks, fp)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *signed, pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *[pa.array(low[:, k]) for k in range(4)]], names=["doc_id", "th", "node", "mark", "fp", "size", "bands", *lows])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, th long, node long, mark long, fp long, size long, bands array<long>, {', '.join(f'{c} long' for c in lows)}")


def parts_of(ends: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, parts``: the sorted 64-bit hashes of the distinct shingles of each ``node``; a text is cut once, however many pairs it is in."""
    # any text of a node will do: its words are the node's
    one = rows.join(ends, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th"))
    texts = docs.select(F.xxhash64("text").alias("th"), "text").join(one, "th").groupBy("node").agg(F.first("text").alias("text"))

    def hashed(batches):
        for b in batches:
            parts = [np.array(sorted(xxhash.xxh64_intdigest(p) for p in shingles(t.as_py())), dtype=np.uint64).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.int64()))], names=["node", "parts"])

    return written(texts.mapInArrow(hashed, "node long, parts array<long>"), "near-texts")


def similar_pairs(pairs: DataFrame, rows: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Those pairs ``u, v`` of nodes whose texts are similar."""
    pairs = written(pairs.distinct(), "near-pairs")
    texts = parts_of(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), rows, docs)
    both = pairs.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v")

    def work(batches):
        for b in batches:
            keep = [similar_parts(x.values.to_numpy(), y.values.to_numpy(), least) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    out = written(both.select("u", "v", "a", "b").mapInArrow(work, "u long, v long"), "near-links")
    for t in (pairs, texts):
        dropped(t)
    return out


def may_be_similar(x: dict, y: dict, least: float) -> np.ndarray:
    """Whether size, fingerprint and lowest bits of MinHashes allow the similarity: one row's against arrays of others'."""
    size = np.minimum(x["size"], y["size"]) >= np.maximum(x["size"], y["size"]) * least - 1e-9
    unlike = sum(np.bitwise_count(x[f"low{k}"] ^ y[f"low{k}"]).astype(np.int64) for k in range(4))
    return size & (np.bitwise_count(x["fp"] ^ y["fp"]) <= REACH) & (unlike <= UNLIKE)


def linked_slices(part: pd.DataFrame, bucket: int, i: int, j: int, least: float) -> pd.DataFrame:
    """A spanning forest ``u, v`` of the similar pairs of slices ``i`` and ``j`` of a bucket that are not of one group yet.

    A pair that shares several buckets is looked at in the first of its bands alone.
    """
    part = part.sort_values("node")
    node, g, apart, own = (part[c].to_numpy() for c in ("node", "g", "apart", "slice"))
    told = {c: part[c].to_numpy().astype(np.int64).view(np.uint64) if c != "size" else part[c].to_numpy() for c in ("fp", "size", *[f"low{k}" for k in range(4)])}
    bands, parts = np.array(part["bands"].tolist(), dtype=np.int64), part["parts"].tolist()
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (higher := up.get(x, x)) != x:
            up[x] = up.get(higher, higher)
            x = higher
        return x

    out = []
    for a in range(len(node) - 1):
        rest = slice(a + 1, None)
        ask = (g[rest] != g[a]) & (apart[rest] | apart[a]) & may_be_similar({c: v[a] for c, v in told.items()}, {c: v[rest] for c, v in told.items()}, least)
        at = np.flatnonzero(ask & (own[rest] != own[a]) if i != j else ask) + a + 1
        at = at[bands[a][(bands[at] == bands[a]).argmax(1)] == bucket]
        for b in at:
            x, y = root(g[a]), root(g[b])
            if x != y and similar_parts(parts[a], parts[b], least):
                up[x] = y
                out.append((node[a], node[b]))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def wide_links(told: DataFrame, nodes: DataFrame, rows: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Links of large buckets: slices of bounded size meet two by two, and a task returns a forest, not pairs."""
    told = written(told, "near-wide-members")
    texts = parts_of(told.select("node").distinct(), rows, docs)
    many = F.ceil(F.greatest(F.sum("size") / SLICE_PARTS, F.count("*") / SLICE_ROWS)).cast("int")
    cut = told.join(told.groupBy("bucket").agg(many.alias("many")), "bucket").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    sent = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumns({"i": F.least("slice", "other"), "j": F.greatest("slice", "other")})
    sent = sent.drop("many", "other").join(texts, "node").join(nodes.select("node", "bands"), "node")
    return sent.groupBy("bucket", "i", "j").applyInPandas(lambda key, part: linked_slices(part, *key, least), "u long, v long")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of nodes that the vantage-point trees link by their fingerprints ``mark``: one node stands for those of a fingerprint, and is paired with them."""
    first = written(nodes.groupBy("mark").agg(F.min("node").alias("node")), "near-marks")
    links = linked(first.select(F.col("mark").alias("fp")))
    between = links.join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select("a", "b")
    within = nodes.select("mark", F.col("node").alias("b")).join(first.toDF("mark", "a"), "mark").where("a <> b").select("a", "b")
    return between.union(within).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def similar_groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, th, node, component`` of every document: groups of texts whose shingles are similar, of pairs that fingerprints or MinHashes bring together."""
    rows = written(sketches(docs), "near-sketches")
    # equal texts are one node before anything is compared
    lows = [f"low{k}" for k in range(4)]
    nodes = written(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("mark", "fp", "size", "bands", *lows)]), "near-nodes")
    stood = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = stood.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("bucket")
    members = stood.join(shared, "bucket").join(nodes.drop("bands", "mark"), "node").select("bucket", "node", "fp", "size", *lows)

    def near(a, b):
        return (F.least(a["size"], b["size"]) >= F.greatest(a["size"], b["size"]) * least - 1e-9) & (hamming(a["fp"], b["fp"]) <= REACH) & (sum((hamming(a[c], b[c]) for c in lows), F.lit(0)) <= UNLIKE)

    verify = lambda pairs: similar_pairs(pairs, rows, docs, least)
    labels = same_group(members, near, verify, "near", fingerprint_pairs(nodes), wide=lambda told: wide_links(told, nodes, rows, docs, least))
    return rows.join(labels, rows.node == labels.id, "left").select("doc_id", "th", "node", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents with their own columns, one of each ``component`` in ``groups`` (``doc_id, th, component``).

    The least id that is not null stays, of rows that share it the one whose
    text hash is least, once. Components without any id keep the row with the
    least text hash.
    """
    ident, th, own = fresh(docs, "kept_id", "kept_th", "own_th")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = groups.groupBy("component").agg(F.min(place).alias("p"))
    keep = written(first.select(F.col("p.doc_id").alias(ident), F.col("p.th").alias(th)), "kept-ids")
    told = docs.withColumn(own, F.xxhash64("text"))
    match = F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(th))
    return told.join(keep, match, "left_semi").dropDuplicates(["doc_id", own]).select(*docs.columns)


def deduplicated(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One document of each group of fingerprints within ``bits`` bits."""
    return one_of_each(docs, grouped(docs, bits))


def without_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each group of texts whose word shingles are similar."""
    return one_of_each(docs, similar_groups(docs, least))

"""Exact substring dedup by a sparse, distributed suffix array (operator 2).

Every byte is found that a string of ``LENGTH`` bytes covers which also starts
anywhere else, in the same text or another. Sorting all suffixes would move each
text hundreds of times, so suffixes start at anchors only: the anchor of a
window of ``LENGTH`` bytes is its least hashed ``TOKEN``-byte string, leftmost
first. Equal windows have equal anchors at equal offsets, so no pair of equal
windows is missed, and about one position in 185 is an anchor.

1. Each text gives its anchors, each with the run of windows it stands for and
   a hash of the bytes that these windows span (the context).
2. Equal contexts are counted with map-side combining: however often a passage
   is copied, one row stands for it from here on.
3. Anchors whose leading token stands in several contexts are fetched with
   their bytes and range-partitioned by sampled splitters over their leading
   bytes. A bucket sorts suffixes, and the reversed bytes before them, by multikey
   quicksort and takes the common prefix lengths of neighbours. Two windows are
   equal if they fall into one class of both orders at their offset.
4. A token's contexts go to one bucket, unless there are more than a bucket may
   hold. Those tokens are split by the bytes that follow, and are compared across
   the buckets' boundaries: their windows are hashed, counted with map-side
   combining and joined back, so a token of any frequency needs no task of its own.

Defined results: null is the empty text; texts under ``LENGTH`` bytes keep all;
equal rows repeat each other, so both lose what they share; ids may be null or
repeat; very long texts are judged whole; an empty table gives no rows; further columns
are left alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.llm.common import written

LENGTH, TOKEN = 400, 32
BLOCK = 1 << 20
#: Suffixes that a bucket is meant to hold.
BUCKET_ROWS = 12_000
#: Contexts of one token that may share a bucket (about 1.2 KB of memory each); a token with more is split over buckets.
TOKEN_ROWS = 50_000
PLACE_BITS = 21


def token_hashes(data: np.ndarray, token: int = TOKEN) -> np.ndarray:
    """A 64-bit hash of the ``token`` bytes (a power of two) from each position."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width = 1
    while width < token:
        h = h[:-width] * np.uint64(0xBF58476D1CE4E5B9 + 2 * width) + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    step = 1
    while step * 2 <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    rest = width - step
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def anchored(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, token: int = TOKEN, block: int = BLOCK):
    """Yield ``(first window, last window, anchor, token hash)`` arrays for texts that lie one after another in ``data``."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, len(data) - length + 1, block):
        part = data[at : at + block + length - 1]
        n = len(part) - length + 1
        valid = np.ones(n, dtype=bool)
        for e in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + n + length, "left")].tolist():
            valid[max(0, e - length + 1 - at) : max(0, e - at)] = False
        starts = np.flatnonzero(valid)
        if not len(starts):
            continue
        h = token_hashes(part, token)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_least(packed, length - token + 1) & low).astype(np.int64)[starts]
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(starts)])) - 1
        yield starts[first] + at, starts[last] + at, anchor[first] + at, h[anchor[first]]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after another, and the offsets of its rows (one more than rows)."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


ANCHORS = "token long, context long, th long, at long, lead int, more int"


def anchors_of(docs: DataFrame, length: int = LENGTH, token: int = TOKEN) -> DataFrame:
    """``doc_id`` and a row's ``th``, token and context hash, first window, bytes before the anchor, and windows after the first."""

    def work(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            view = memoryview(data)
            for first, last, anchor, h in anchored(data, offsets[1:], length, token):
                doc = np.searchsorted(offsets, first, "right") - 1
                context = np.fromiter((xxhash.xxh3_64_intdigest(view[i : j + length]) for i, j in zip(first.tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=len(first))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), b.column("th").take(pa.array(doc)),
                        pa.array(first - offsets[doc]), pa.array((anchor - first).astype(np.int32)), pa.array((last - first).astype(np.int32)),
                    ],
                    names=["doc_id", "token", "context", "th", "at", "lead", "more"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, {ANCHORS}")


def multikey_sorted(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian 8-byte words by multikey quicksort: three ways about a pivot word, equal rows go one word deeper."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        rows = order[lo:hi]
        if hi - lo <= 24:
            rest = words[rows, depth:]
            order[lo:hi] = rows[sorted(range(hi - lo), key=[r.tobytes() for r in rest.byteswap()].__getitem__)]
            continue
        key = words[rows, depth]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate((rows[less], rows[same], rows[more]))
        a, b = lo + int(less.sum()), hi - int(more.sum())
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def laid_out(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes, padded with zeros to a multiple of eight."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)


def classes(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, length of the prefix that each row in order shares with the one before it)."""
    raw = laid_out(strings, width)
    order = multikey_sorted(raw.view(">u8").astype(np.uint64))
    shared = np.zeros(len(order), dtype=np.int32)
    for at in range(1, len(order), 4096):
        a, b = raw[order[at - 1 : at + 4095]], raw[order[at : at + 4096]]
        differ = a[: len(b)] != b
        shared[at : at + 4096] = np.where(differ.any(1), differ.argmax(1), raw.shape[1])
    return order, shared


def repeated_windows(right: list[bytes], left: list[bytes], lead: np.ndarray, more: np.ndarray, length: int = LENGTH, token: int = TOKEN) -> np.ndarray:
    """Whether the window that starts ``o`` bytes before a row's anchor equals another row's: rows x offsets.

    ``right`` holds the bytes from the anchor on, ``left`` those before it,
    reversed. A row's windows have offsets ``lead - more`` to ``lead``.
    """
    n, top = len(right), length - token
    found = np.zeros((n, top + 1), dtype=bool)
    (ro, rs), (lo, ls) = classes(right, length), classes(left, max(top, 1))
    r_class, l_class = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(top + 1):
        rows = np.flatnonzero((lead - more <= o) & (o <= lead))
        if len(rows) < 2:
            continue
        r_class[ro] = np.cumsum(rs < length - o)
        l_class[lo] = np.cumsum(ls < o) if o else 0
        both = r_class[rows] * (n + 1) + l_class[rows]
        turn = np.argsort(both, kind="stable")
        same = both[turn][1:] == both[turn][:-1]
        again = np.zeros(len(rows), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        found[rows[turn[again]], o] = True
    return found


def stretches(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal stretches covered by windows of ``length`` from the sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    return list(zip(starts[np.concatenate(([0], cut))].tolist(), (starts[np.concatenate((cut, [len(starts)])) - 1] + length).tolist(), strict=True))


def near(docs: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Join documents with a table by ``__id`` and ``__th``; how is Spark's choice, as the table grows with the documents."""
    return docs.join(table, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), how)


def covered(docs: DataFrame, length: int = LENGTH, token: int = TOKEN, bucket_rows: int = BUCKET_ROWS, token_rows: int = TOKEN_ROWS) -> DataFrame:
    """``doc_id, th, s, e``: stretches of bytes that repeated strings cover; they may touch and overlap."""
    kind = dict(docs.dtypes)["doc_id"]
    anchors = written(anchors_of(docs, length, token), "anchors")
    groups = anchors.groupBy("token", "context").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "th", "at", "lead", "more")])
    kinds = written(groups, "contexts")
    shared = kinds.groupBy("token").agg(F.count("*").alias("k"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")).where("k > 1 and single > 0").select("token", (F.col("k") > token_rows).alias("split"))
    whole = anchors.join(kinds.where("n > 1").select("token", "context"), ["token", "context"]).select("doc_id", "th", F.col("at").alias("s"), (F.col("at") + F.col("more") + length).alias("e"))

    # contexts of tokens that stand in several, with their bytes
    asked = kinds.join(shared, "token").groupBy("doc_id", "th").agg(F.collect_list(F.struct("token", "context", "n", "at", "lead", "more", "split")).alias("asked"))
    asked = written(asked.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "asked"), "asked")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    # rows that repeat an id and text give the same contexts, which then simply meet themselves: one row of them asks
    held = near(texts, asked, "inner").select("doc_id", "th", "text", "asked")
    shape = f"doc_id {kind}, token long, context long, n long, th long, at long, lead int, more int, split boolean, suffix binary, before binary"

    def fetch(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            rows = []
            for d, (doc_id, th, asked_of) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("asked").to_pylist(), strict=True)):
                for x in asked_of:
                    first = int(offsets[d]) + x["at"]
                    anchor = first + x["lead"]
                    rows.append((doc_id, x["token"], x["context"], x["n"], th, x["at"], x["lead"], x["more"], x["split"], data[anchor : first + x["more"] + length].tobytes(), data[first:anchor][::-1].tobytes()))
                    if len(rows) >= 8192:
                        yield batch_of(rows, b.schema.field("doc_id").type)
                        rows = []
            if rows:
                yield batch_of(rows, b.schema.field("doc_id").type)

    contexts = written(held.mapInArrow(fetch, shape).dropDuplicates(["token", "context"]) if has_repeats(texts, asked) else held.mapInArrow(fetch, shape), "suffixes")
    n_rows = contexts.count()
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / bucket_rows))
    found_shape = f"doc_id {kind}, th long, s long, e long, edge long"

    def sort(batches):
        cols = [x for x in batches if x.num_rows]
        if not cols:
            return
        t = pa.Table.from_batches(cols)
        right, left = t.column("suffix").to_pylist(), t.column("before").to_pylist()
        lead, more = (t.column(c).to_numpy().astype(np.int64) for c in ("lead", "more"))
        hits = repeated_windows(right, left, lead, more, length, token)
        yield from found_batches(t, [lead[i] - np.flatnonzero(hits[i])[::-1] for i in range(len(lead))], edges(right, t.column("token").to_pylist()), length)

    further = [F.when(F.col("split"), x) for x in (F.substring("suffix", 1, 64), F.substring("before", 1, 32), F.col("context"))]
    ranged = contexts.repartitionByRange(n, F.substring("suffix", 1, token), *further)
    sorted_out = written(ranged.mapInArrow(sort, found_shape), "sorted")
    over = sorted_out.where("edge is not null").groupBy("edge").count().where("count > 1").select(F.col("edge").alias("token"))

    # tokens on both sides of a bucket's edge: their windows meet by hash
    def windows(batches):
        for b in batches:
            got: list[tuple[int, int, int]] = []
            for right, left, lead, more, context in zip(*(b.column(c).to_pylist() for c in ("suffix", "before", "lead", "more", "context")), strict=True):
                text = left[::-1] + right
                for i in range(more + 1):
                    x = xxhash.xxh3_128_intdigest(text[i : i + length])
                    got.append((x >> 64, x & (1 << 64) - 1, context, i))
            if got:
                h, low, context, i = zip(*got, strict=True)
                signed = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (h, low)]
                yield pa.RecordBatch.from_arrays([*signed, pa.array(context, pa.int64()), pa.array(i, pa.int32())], names=["h", "l", "context", "i"])

    crossing = contexts.join(F.broadcast(over), "token", "left_semi")  # a bucket has two edges, so this list is bounded by the buckets
    seen = crossing.select("suffix", "before", "lead", "more", "context").mapInArrow(windows, "h long, l long, context long, i int")
    many = seen.groupBy("h", "l").agg(F.count("*").alias("c")).where("c > 1").select("h", "l")
    starts = seen.join(many, ["h", "l"]).groupBy("context").agg(F.sort_array(F.collect_list("i")).alias("starts"))
    located = crossing.where("n = 1").select("context", "doc_id", "th", "at").join(starts, "context")
    met = located.select("doc_id", "th", "at", F.explode("starts").alias("i")).select("doc_id", "th", (F.col("at") + F.col("i")).alias("s"), (F.col("at") + F.col("i") + length).alias("e"))
    return whole.union(sorted_out.where("edge is null").select("doc_id", "th", "s", "e")).union(met)


def has_repeats(texts: DataFrame, asked: DataFrame) -> bool:
    """Whether several rows have one id and text, so that each would ask for the same contexts."""
    return bool(texts.groupBy("doc_id", "th").count().where("count > 1").limit(1).count())


def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "token", "context", "n", "th", "at", "lead", "more", "split", "suffix", "before"]
    types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def edges(right: list[bytes], tokens: list[int]) -> list[int]:
    """Tokens of a bucket's first and last suffix."""
    return sorted({tokens[min(range(len(right)), key=right.__getitem__)], tokens[max(range(len(right)), key=right.__getitem__)]})


def found_batches(t: pa.Table, starts: list[np.ndarray], edge: list[int], length: int):
    """Rows of stretches for the contexts that occur once, and of the bucket's edge tokens."""
    ids, ths, ats, ns = (t.column(c).to_pylist() for c in ("doc_id", "th", "at", "n"))
    rows = [(ids[i], ths[i], ats[i] + s, ats[i] + e, None) for i, x in enumerate(starts) if ns[i] == 1 for s, e in stretches(x, length)]
    rows += [(None, None, None, None, x) for x in edge]
    types = [t.schema.field("doc_id").type, *[pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "th", "s", "e", "edge"])


def cut_out(docs: DataFrame, with_text: bool = False, **how) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the remaining bytes)."""
    spans = covered(docs, **how).groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = written(spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "spans"), "stretches")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    rows = near(texts, spans, "left").select("doc_id", "text", "spans")

    def cut(batches):
        for b in batches:
            data, offsets = utf8(b.column("text"))
            got = []
            for d, found in enumerate(b.column("spans").to_pylist()):
                mine = data[offsets[d] : offsets[d + 1]]
                kept, runs, last, at = [], 0, -1, 0
                for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                    if s > last:
                        runs += 1
                        kept.append(mine[at:s])
                    last = max(last, e)
                    at = last
                kept.append(mine[max(at, 0) :])
                rest = b"".join(x.tobytes() for x in kept)
                got.append((len(mine), len(mine) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            n, removed, runs, sha, rest = zip(*got, strict=True) if got else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(rest, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    out = rows.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")

"""Hard-negative mining over one-dimensional distance keys (operator 13).

Vectors are multiplied, rounded down to whole numbers and given one more component,
so that all have the same length: the nearer such a vector is to an anchor (whose
further component is zero), the larger their inner product, and the order is the
same. Each vector belongs to the nearest of a few pivots, and the table is stored
sorted by (pivot, distance to it), in blocks. A key interval of a pivot is an
annulus around it, so the distance of an anchor to a pivot bounds, by the triangle
inequality, the scores of each block on both sides.

An anchor scans blocks in the order of their bounds, in three rounds of Spark jobs:
the nearest annuli, more of them, and then all that can still hold a better row
than the last of those found. Positives come first; their scores give the windows
that negatives must lie in, and then only blocks whose scores can meet a window are
scanned for it. Bounds are widened by more than any rounding, scores are exact, and
nothing is left out, so the result is that of a full scan. A scan is one matrix
product of a block and a bounded group of anchors.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part; shorter vectors count as filled up with zeros; equal scores
are ordered by id, null ids last, then by row; rows are told apart by their place in
the table, so repeated rows are rows of their own, anchors too; anchors without
positives, and positives without negatives, give no rows; an empty table gives none;
vectors with a squared length of 2^62 or more raise an error; further columns do not
matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from gradeworks.llm.common import dropped, written

#: Pivots, and rows (first by a hash) that they are fitted on. Every row is indexed.
PIVOTS, SAMPLE = 64, 4096
#: Rows of a block, anchors that meet it in one task, and blocks that an anchor scans in the first rounds.
BLOCK_ROWS, ANCHOR_GROUP, ROUNDS = 1024, 512, (2, 16)
LEAST, MOST = -(2**63), 2**63 - 1


def cleaned(df: DataFrame, ident: str, vec: str, label: str, is_anchor: Column, scale: int) -> DataFrame:
    """``row, id, label, anchor, q, norm`` of the rows that take part; ``q`` are whole numbers, ``norm`` their squared length."""
    x = F.col(vec).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    q = F.transform(x, lambda v: F.floor(scale * v))
    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull() & finite)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("id"), F.col(label).alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), q.alias("q"))
    return written(rows.withColumn("norm", F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v * v)), "vectors")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    """A column of lists as a matrix, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(kind)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lists), dim), dtype=kind)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def augmented(q: np.ndarray, norm: np.ndarray, largest: int) -> np.ndarray:
    return np.column_stack([q, np.sqrt(np.maximum(largest - norm, 0))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((points**2).sum(1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(1)[None, :], 0))


def fitted_pivots(sample: np.ndarray, many: int, rounds: int = 10) -> np.ndarray:
    """Centres of the sample by k-means."""
    centres = sample[:many].copy()
    for _ in range(rounds):
        near = distances(sample, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(0)
    return centres


def stored(rows: DataFrame, pivots: np.ndarray, dim: int, largest: int) -> DataFrame:
    """The rows sorted by (pivot, distance), with their block: a run of at most ``BLOCK_ROWS`` of a pivot's rows."""
    most = BLOCK_ROWS
    kinds = dict(rows.dtypes)
    schema = f"row long, id {kinds['id']}, label {kinds['label']}, anchor boolean, q array<long>, norm long"

    def key(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            d = distances(augmented(matrix(t["q"], dim), t["norm"].to_numpy(), largest), pivots)
            near = d.argmin(1)
            yield from t.append_column("pivot", pa.array(near.astype(np.int32))).append_column("dist", pa.array(d[np.arange(len(d)), near])).to_batches()

    def block(batches):
        last, held, number = None, 0, TaskContext.get().partitionId() << 32
        for b in batches:
            p = b.column(b.schema.get_field_index("pivot")).to_numpy()
            out = np.empty(len(p), dtype=np.int64)
            for start, end in zip(edges := [0, *(np.flatnonzero(np.diff(p)) + 1)], [*edges[1:], len(p)], strict=True):
                if start == end:
                    continue
                if p[start] != last or held == most:
                    last, held, number = p[start], 0, number + 1
                place = held + np.arange(end - start)
                out[start:end] = number + place // most
                number, held = number + int(place[-1]) // most, int(place[-1]) % most + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "block"])

    keyed = written(rows.mapInArrow(key, f"{schema}, pivot int, dist double"), "keyed")
    order = ("pivot", "dist", "row")
    out = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(block, f"{schema}, pivot int, dist double, block long"), "by-pivot")
    dropped(keyed)
    return out


def bounded(table: DataFrame, anchors: DataFrame, pivots: np.ndarray, dim: int, largest: int) -> DataFrame:
    """``anchor, block, low, high``: between which scores of an anchor a block's rows lie."""

    def reach(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            q = matrix(t["q"], dim)
            d = distances(np.column_stack([q, np.zeros(len(q))]), pivots)
            yield from pa.table({"anchor": np.repeat(t["row"].to_numpy(), len(pivots)), "norm": np.repeat(t["norm"].to_numpy(), len(pivots)), "pivot": np.tile(np.arange(len(pivots), dtype=np.int32), len(q)), "d": d.ravel()}).to_batches()

    blocks = written(table.groupBy("block", "pivot").agg(F.min("dist").alias("inner"), F.max("dist").alias("outer")), "blocks")
    reached = written(anchors.select("row", "q", "norm").mapInArrow(reach, "anchor long, norm long, pivot int, d double"), "reach")
    near = F.greatest(F.lit(0.0), F.col("d") - F.col("outer"), F.col("inner") - F.col("d"))
    far = F.col("d") + F.col("outer")
    score = lambda r: (F.col("norm") + largest - r * r) / 2
    slack = 1 + 1e-9 * largest
    out = reached.join(blocks, "pivot").select("anchor", "block", F.floor(score(far) - slack).alias("low"), F.ceil(score(near) + slack).alias("high"))
    return written(out, "bounds")


def scanned(table: DataFrame, pairs: DataFrame, anchors: DataFrame, groups: int, k: int, dim: int, same_label: bool, exact: type) -> DataFrame:
    """``anchor, slot, row, id, score``: the best ``k`` rows of each pair's block for each of the anchor's windows ``(slot, least, most)``."""
    group = F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")
    wanted = pairs.join(anchors.select(F.col("row").alias("anchor"), F.col("label").alias("own"), F.col("q").alias("a")), "anchor")
    wanted = wanted.select("block", group.alias("g"), "anchor", "own", "a", "windows")
    blocks = table.select("block", "row", "id", "label", "q").join(pairs.select("block", group.alias("g")).distinct(), "block")
    kind = dict(table.dtypes)["id"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls last
        scores = (matrix(right["a"], dim, exact) @ matrix(left["q"], dim, exact).T).astype(np.int64)
        codes = pa.chunked_array([*left["label"].chunks, *right["own"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        rows = left["row"].to_numpy()
        fits = codes[len(rows) :, None] == codes[None, : len(rows)]
        fits = fits & (right["anchor"].to_numpy()[:, None] != rows[None, :]) if same_label else ~fits
        found = []
        for i, windows in enumerate(right["windows"].to_pylist()):
            at = np.flatnonzero(fits[i])
            s = scores[i, at]
            for w in windows:
                inside = np.flatnonzero((s >= w["least"]) & (s <= w["most"]))
                first = inside[np.argsort(-s[inside], kind="stable")[:k]]
                found.append((np.full(len(first), i), np.full(len(first), w["slot"]), at[first], s[first]))
        i, slot, d, s = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        return pa.table({"anchor": right["anchor"].take(pa.array(i)), "slot": slot.astype(np.int32), "row": left["row"].take(pa.array(d)), "id": left["id"].take(pa.array(d)), "score": s})

    return blocks.groupBy("block", "g").cogroup(wanted.groupBy("block", "g")).applyInArrow(work, f"anchor long, slot int, row long, id {kind}, score long")


def found(table: DataFrame, anchors: DataFrame, bounds: DataFrame, windows: DataFrame, groups: int, k: int, dim: int, same_label: bool, exact: type, rounds: tuple[int, ...]) -> DataFrame:
    """``anchor, slot, row, id, score, rank``: the ``k`` best rows of each window ``anchor, slot, least, most``."""
    hits = done = None
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    for most in (*rounds, None):
        now = windows
        if hits is not None:
            full = hits.groupBy("anchor", "slot").agg(F.min("score").alias("s"), F.count("*").alias("c")).where(F.col("c") >= k).select("anchor", "slot", "s")
            now = windows.join(full, ["anchor", "slot"], "left").withColumn("least", F.coalesce("s", "least")).drop("s")
        asked = now.groupBy("anchor").agg(F.collect_list(F.struct("slot", "least", "most")).alias("windows"))
        meets = F.filter("windows", lambda w: (F.col("high") >= w["least"]) & (F.col("low") <= w["most"]))
        left = bounds.join(asked, "anchor").withColumn("windows", meets).where(F.size("windows") > 0)
        if done is not None:
            left = left.join(done, ["anchor", "block"], "left_anti")
        if most is not None:
            left = left.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("high"), "block"))).where(F.col("r") <= most)
        pairs = written(left.select("anchor", "block", "windows"), "scans")
        new = scanned(table, pairs, anchors, groups, k, dim, same_label, exact)
        both = new if hits is None else hits.drop("rank").unionByName(new)
        before, hits = hits, written(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "hits")
        seen = pairs.select("anchor", "block")
        if before is not None:
            dropped(before)
        done = seen if done is None else done.union(seen)
    return hits


def hundredths(share: int, up: bool) -> Column:
    """So many hundredths of the positive's score, rounded down or up, in whole numbers alone."""
    sign = "-" if up else ""
    return F.expr(f"{sign}(({sign}{share} * positive_score - pmod({sign}{share} * positive_score, 100L)) div 100)")


def mined(
    df: DataFrame, ident: str, vec: str, label: str, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, rounds: tuple[int, ...] = ROUNDS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are the rows of its label with the highest scores; each
    positive's negatives are the highest-scoring rows of other labels with ``low``
    to ``high`` hundredths of its score.
    """
    rows = cleaned(df, ident, vec, label, is_anchor, scale)
    n, largest, dim = rows.agg(F.count("*"), F.max("norm"), F.max(F.size("q"))).first()
    kind = dict(rows.dtypes)["id"]
    if not n:
        return df.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    if largest >= 2**62:
        raise OverflowError("a vector is too long for exact scores in 64 bits")
    dim, exact = max(dim, 1), np.float64 if largest < 2**53 else np.int64
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("q", "norm").toArrow()
    pivots = fitted_pivots(augmented(matrix(sample["q"], dim), sample["norm"].to_numpy(), largest), PIVOTS)
    table = stored(rows, pivots, dim, largest)
    anchors = written(table.where("anchor").select("row", "id", "label", "q", "norm"), "anchors")
    groups = max(1, -(-anchors.count() // ANCHOR_GROUP))
    bounds = bounded(table, anchors, pivots, dim, largest)
    all_scores = anchors.select(F.col("row").alias("anchor"), F.lit(0).alias("slot"), F.lit(LEAST).cast("long").alias("least"), F.lit(MOST).cast("long").alias("most"))
    near = found(table, anchors, bounds, all_scores, groups, positives, dim, True, exact, rounds)
    near = near.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = written(near.select("anchor", "slot", hundredths(low, True).alias("least"), hundredths(high, False).alias("most")).where("least <= most"), "windows")
    far = found(table, anchors, bounds, windows, groups, negatives, dim, False, exact, rounds)
    out = far.join(near, ["anchor", "slot"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

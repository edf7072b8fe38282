"""Keyed, interval and similarity joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.operators import metric
from gradeworks.sources.scratch import written


def reindexed(ids: DataFrame, values: DataFrame, key: str, order: str) -> DataFrame:
    """Values for every id in the ids' order; an id without a value raises."""
    out = ids.join(values.withColumn("__there", F.lit(True)), key, "left")
    if out.where("__there is null").limit(1).count():
        raise KeyError(f"a {key} has no row")
    return out.drop("__there").orderBy(order)


def in_intervals(points: DataFrame, intervals: DataFrame, key: str, start: str, end: str, low: str, high: str, width: float) -> DataFrame:
    """Points whose middle lies in ``[low, high)`` of an interval of the same key.

    Both sides are dealt by key and time bin, so a key with very many points
    spreads over its bins, and a point only meets intervals that touch its bin.
    """
    middle = 0.5 * (F.col(start) + F.col(end))
    p = points.withColumn("__mid", middle).withColumn("__bin", F.floor(F.col("__mid") / width))
    spans = intervals.where(F.col(low) < F.col(high))
    i = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(i, [key, "__bin"]).where((F.col("__mid") >= F.col(low)) & (F.col("__mid") < F.col(high))).drop("__mid", "__bin")


def similar_pairs(df: DataFrame, ident: str, vec: str, cut: float, block_rows: int | None = None, gathered: Callable | None = None) -> DataFrame:
    """All pairs ``a < b`` whose dot product is above the cut, with it.

    Rows are multiplied block by block. Pairs of blocks that the metric index
    shows to hold no such pair are skipped.
    """
    rows = written(metric.plain(df, ident, vec), "vectors")
    if not rows.limit(1).count():
        return df.sparkSession.createDataFrame([], "a long, b long, sim double")
    few = rows.count() <= (block_rows or metric.BLOCK_ROWS)
    index = metric.single(rows) if few else metric.indexed(rows, metric.chosen_pivots(rows), block_rows)
    pairs = written(metric.block_pairs(index, index, cut).where("i <= j"), "block-pairs")

    def multiply(left: pd.DataFrame, right: pd.DataFrame, i: int, j: int) -> pd.DataFrame:
        sims = metric.matrix(left["vec"]) @ metric.matrix(right["vec"]).T
        r, c = np.nonzero(sims > cut)
        a, b = left["id"].to_numpy()[r], right["id"].to_numpy()[c]
        keep = a < b if i == j else np.ones(len(a), dtype=bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": sims[r, c][keep]})

    how = (lambda x: gathered(multiply(*x)), gathered) if gathered else (lambda x: multiply(*x), None)
    return metric.multiplied(index, index, pairs, lambda *x: how[0](x), "a long, b long, sim double", how[1])


def spanning(df: DataFrame, ident: str, vec: str, cut: float, block_rows: int | None = None) -> DataFrame:
    """Links ``a < b`` that connect what the pairs whose dot product is above the cut connect, and nothing else.

    A task keeps a spanning forest of the pairs of its blocks: links are fewer than its rows, however many pairs there are.
    """

    def forest(found: pd.DataFrame) -> pd.DataFrame:
        ids, ends = np.unique(found[["a", "b"]].to_numpy(), return_inverse=True)
        u, v = ends.reshape(-1, 2).T
        least = np.arange(len(ids))
        while (least[u] != least[v]).any():
            low = np.minimum(least[u], least[v])
            np.minimum.at(least, least[u], low)
            np.minimum.at(least, least[v], low)
            while (least != least[least]).any():
                least = least[least]
        tied = np.flatnonzero(least != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[least[tied]], "b": ids[tied], "sim": 0.0})

    return similar_pairs(df, ident, vec, cut, block_rows, forest).select("a", "b")


def leakage(df: DataFrame, ident: str, vec: str, cut: float, clusters: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``threshold, pairs, apart``: the pairs whose dot product is above the cut, and how many of them lie in two clusters of ``id, threshold, cluster``.

    A task counts the pairs of its blocks, so no pair leaves it.
    """
    rows = written(metric.plain(df, ident, vec), "vectors")
    if not rows.limit(1).count():
        return df.sparkSession.createDataFrame([], "threshold double, pairs long, apart long")
    cuts = [r[0] for r in clusters.select("threshold").distinct().orderBy("threshold").collect()]
    marks = clusters.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("threshold", "cluster"))), lambda x: x["cluster"]).alias("marks"))
    few = rows.count() <= (block_rows or metric.BLOCK_ROWS)
    index = metric.single(rows) if few else metric.indexed(rows, metric.chosen_pivots(rows), block_rows)
    pairs = written(metric.block_pairs(index, index, cut).where("i <= j"), "block-pairs")
    index.rows = written(index.rows.join(marks, "id"), "blocked")

    def count(left: pd.DataFrame, right: pd.DataFrame, i: int, j: int) -> pd.DataFrame:
        r, c = np.nonzero(metric.matrix(left["vec"]) @ metric.matrix(right["vec"]).T > cut)
        if i == j:
            keep = left["id"].to_numpy()[r] < right["id"].to_numpy()[c]
            r, c = r[keep], c[keep]
        a, b = (np.array(part["marks"].tolist(), dtype=np.int64) for part in (left, right))
        return pd.DataFrame({"place": np.arange(len(cuts)), "pairs": len(r), "apart": [int((a[r, k] != b[c, k]).sum()) for k in range(len(cuts))]})

    found = metric.multiplied(index, index, pairs, count, "place long, pairs long, apart long", lambda t: t.groupby("place", as_index=False).sum())
    named = F.get(F.array(*[F.lit(t) for t in cuts]), F.col("place").cast("int"))
    return found.groupBy(named.alias("threshold")).agg(F.sum("pairs").alias("pairs"), F.sum("apart").alias("apart"))


def nearest(queries: DataFrame, base: DataFrame, ident: str, vec: str, exclude_self: bool = True, block_rows: int | None = None, digits: int | None = None) -> DataFrame:
    """The base row with the largest dot product (to so many ``digits``) for each query: ``id, nn, sim``; ties go to the least id.

    Each block of queries first meets the block with the largest bound. The least
    of its rows' best products so far is what another block's bound has to reach.
    """
    base, queries = (written(metric.plain(df, ident, vec), "vectors") for df in (base, queries))
    if not base.limit(1).count():
        return base.sparkSession.createDataFrame([], "id long, nn long, sim double")
    if few := max(base.count(), queries.count()) <= (block_rows or metric.BLOCK_ROWS):
        asked, held = metric.single(queries), metric.single(base)
    else:
        pivots = metric.chosen_pivots(base)
        asked, held = metric.indexed(queries, pivots, block_rows), metric.indexed(base, pivots, block_rows)

    def best(left: pd.DataFrame, right: pd.DataFrame, i: int, j: int) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"i": [], "id": [], "nn": [], "sim": []}).astype({"i": "int64", "id": "int64", "nn": "int64"})
        right = right.sort_values("id")
        sims = metric.matrix(left["vec"]) @ metric.matrix(right["vec"]).T
        if digits is not None:
            sims = sims.round(digits)
        ids = right["id"].to_numpy()
        if exclude_self:
            sims[left["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        at = sims.argmax(1)
        out = pd.DataFrame({"i": i, "id": left["id"].to_numpy(), "nn": ids[at], "sim": sims[np.arange(len(at)), at]})
        return out[np.isfinite(out["sim"])]

    def first_of(found: pd.DataFrame) -> pd.DataFrame:
        """A task's best row for each query: products are equal to the bit or not, and ties go to the least id."""
        return found.sort_values(["i", "id", "sim", "nn"], ascending=[True, True, False, True]).drop_duplicates(["i", "id"])

    schema = "i long, id long, nn long, sim double"
    if few:
        return metric.multiplied(asked, held, metric.block_pairs(asked, held), best, schema).select("id", "nn", "sim")
    bounds = written(metric.block_pairs(asked, held), "block-pairs")
    first = bounds.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("bound"), "j"))).where("r = 1").select("i", "j")
    first = written(first, "block-pairs")
    found = written(metric.multiplied(asked, held, first, best, schema, first_of), "nearest")
    # a row without a product yet leaves its block without a limit
    sizes = asked.rows.join(asked.pieces, "piece").groupBy(F.col("block").alias("i")).agg(F.count("*").alias("n"))
    reached = found.groupBy("i").agg(F.min("sim").alias("least"), F.count("*").alias("c")).join(sizes, "i").where("c = n")
    slack = 10.0**-digits if digits is not None else 0.0
    left = bounds.join(reached.select("i", "least"), "i", "left").where(F.col("least").isNull() | (F.col("bound") + slack >= F.col("least"))).join(first, ["i", "j"], "left_anti")
    left = written(left.select("i", "j"), "block-pairs")
    if left.limit(1).count():
        found = found.unionByName(metric.multiplied(asked, held, left, best, schema, first_of))
    top = found.groupBy("id").agg(F.max(F.struct("sim", (-F.col("nn")).alias("m"))).alias("t"))
    return top.select("id", (-F.col("t.m")).alias("nn"), F.col("t.sim").alias("sim"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in the order; never an order that leaves ties open."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")

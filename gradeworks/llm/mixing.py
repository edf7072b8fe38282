"""Mixing sources to target weights by subset-sum budget fitting (operator 4).

Each source gets a word target. Whole passes over a source are taken while
they fit. For the remaining budget, documents are counted by exact length, a
proportional share of each length is taken, and a bounded-knapsack dynamic
program fits what is then left. The documents of a length are picked in a
seeded order, by count.

Defined results: a null text has size 0 and is taken 0 times; a null source is
a source of its own and comes last; repeated rows are documents of their own
(which of several equal rows is taken is left open, as they cannot be told
apart); a text's length does not matter but for its size; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.llm.common import WORD, written

SEED = 20
#: Most words that the dynamic program fits; the greedy step before it brings the budget down to that.
DP_WORDS = 65_536
#: Rows of a (source, length) group that one ranking group is meant to hold.
RANK_GROUP = 1000
#: Plans of at most so many (source, length) rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


COLUMNS = ("__size", "__source_size", "__target", "__copies")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> dict[str | None, float]:
    """Word targets that share all words by weight; none is above ``most`` times its source's words."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    rest, free, got = float(sum(size.values())), set(size), {}
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > most * size[s]}
        if not over:
            return got | {s: rest * weight[s] / w for s in free}
        for s in over:
            got[s] = most * size[s]
        rest -= sum(got[s] for s in over)
        free -= over
    return got


def fit(length: np.ndarray, count: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget as found, never above it."""
    total = int((length * count).sum())
    take = np.zeros(len(length), dtype=np.int64)
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return count.astype(np.int64)
    share = np.floor(count * (budget / total)).astype(np.int64)
    order = np.lexsort((length, share - count * (budget / total)))
    back = 0
    while True:  # where what is left cannot be met, some of the share is given back and fitted as well
        take, missing = fit_rest(length, count, np.maximum(share - back, 0), order, budget, dp_words)
        gap = budget - int((take * length).sum())
        if back == 0 or gap < best_gap:
            best, best_gap = take, gap
        if not best_gap or not share.any() or back > share.max() or missing > dp_words:
            return best
        back = 2 * back + 1


def fit_rest(length: np.ndarray, count: np.ndarray, take: np.ndarray, order: np.ndarray, budget: int, dp_words: int) -> tuple[np.ndarray, int]:
    """(documents of each length, words that the share left) where the rest is filled greedily down to what the dynamic program takes."""
    take = take.copy()
    left = missing = budget - int((take * length).sum())
    for turn, most in ((order, 1), (np.argsort(-length, kind="stable"), None)):
        for i in turn:
            if left <= dp_words:
                break
            more = int(min(count[i] - take[i], left // length[i]))
            more = min(more, most) if most else more
            take[i] += more
            left -= more * int(length[i])
    cap = int(left)
    reach, last, pieces = np.zeros(cap + 1, dtype=bool), np.full(cap + 1, -1, dtype=np.int64), []
    reach[0] = True
    for i in order:
        spare, k = int(min(count[i] - take[i], cap // length[i])), 1
        while spare > 0:
            part = min(k, spare)
            step = part * int(length[i])
            new = np.zeros(cap + 1, dtype=bool)
            new[step:] = reach[: cap + 1 - step]
            new &= ~reach
            last[new] = len(pieces)
            reach |= new
            pieces.append((i, part))
            spare, k = spare - part, 2 * k
        if reach[cap]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, part = pieces[last[at]]
        take[i] += part
        at -= part * int(length[i])
    return take, missing


def mixed(docs: DataFrame, carry: list[str] | None = None, seed: int = SEED, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Each document with its words, its source's words and target, and how often the mix takes it.

    Columns are those of ``carry`` (``doc_id`` if none are given) and the four
    of ``columns``, which must not be among them. Only one row a source comes
    to the driver; length counts are combined before they are shuffled and
    fitted in one group a source, which has a row for each distinct length.
    """
    spark = docs.sparkSession
    carry = carry or ["doc_id"]
    # the carried columns go under names of their own, as any name may stand among them
    names = [f"__c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], F.col("source").alias("__source"), n_words(F.col("text")).alias("__size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("__h"), F.col("doc_id").alias("__id"))
    if "text" not in carry:  # then each text is read once
        rows = written(rows, "mix-rows")
    lengths = written(rows.groupBy("__source", "__size").agg(F.count("*").alias("n")), "lengths")
    totals = [(r[0], int(r[1] or 0)) for r in lengths.groupBy("__source").agg(F.sum(F.col("__size") * F.col("n"))).collect()]
    wanted = targets(totals)
    size_of = dict(totals)
    sources = spark.createDataFrame([(s, size_of[s], float(t)) for s, t in wanted.items()], "__source string, __source_size long, __target double")

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__size").reset_index(drop=True)
        total, target = int(part["__source_size"].iloc[0]), float(part["__target"].iloc[0])
        passes = int(target // total) if total else 0
        budget = round(target - passes * total)
        some = part["__size"].to_numpy() > 0
        extra = np.zeros(len(part), dtype=np.int64)
        extra[some] = fit(part["__size"].to_numpy()[some], part["n"].to_numpy()[some], budget)
        return part.assign(passes=passes, extra=extra)

    same = F.col("l.__source").eqNullSafe(F.col("s.__source"))
    plan = lengths.alias("l").join(sources.alias("s"), same).select("l.__source", "__size", "n", "__source_size", "__target")
    plan = written(plan.groupBy("__source").applyInPandas(fitted, "__source string, __size long, n long, __source_size long, __target double, passes int, extra long"), "mix-plan")
    n_plan = plan.count()
    p = plan.select(F.col("__source").alias("__s"), F.col("__size").alias("__z"), "n", "__source_size", "__target", "passes", "extra")
    p = F.broadcast(p) if n_plan <= BROADCAST_ROWS else p
    # a length's documents fall into ranking groups by their seeded hash: groups before the last one are taken whole
    u = F.shiftrightunsigned("__h", 11) / F.lit(float(2**53))
    joined = rows.join(p, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z")))
    joined = joined.withColumn("__b", F.floor(u * F.ceil(F.col("n") / RANK_GROUP)).cast("long"))
    if n_plan > BROADCAST_ROWS or plan.where(f"n > {RANK_GROUP}").limit(1).count():
        counted = rows.join(p, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z")))
        groups = counted.groupBy("__s", "__z", F.floor(u * F.ceil(F.col("n") / RANK_GROUP)).cast("long").alias("__g")).agg(F.count("*").alias("c"))
        groups = groups.withColumn("__before", F.sum("c").over(Window.partitionBy("__s", "__z").orderBy("__g")) - F.col("c")).drop("c").withColumnsRenamed({"__s": "__s2", "__z": "__z2"})
        joined = joined.join(groups, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__z") == F.col("__z2")) & (F.col("__b") == F.col("__g")))
    else:
        joined = joined.withColumn("__before", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("__s", "__z", "__b").orderBy("__h", "__id"))
    ranked = joined.withColumn("__k", rank + F.col("__before"))
    copies = (F.col("passes") + F.when(F.col("__k") <= F.col("extra"), 1).otherwise(0)).cast("int")
    own = [F.col(n).alias(c) for c, n in zip(carry, names, strict=True)]
    return ranked.select(*own, F.col("__size").alias(columns[0]), F.col("__source_size").alias(columns[1]), F.col("__target").alias(columns[2]), F.when(F.col("__size") > 0, copies).otherwise(0).alias(columns[3]))


def remixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents with their own columns, each as often as the mix takes it."""
    free = tuple("_" * (1 + max(map(len, docs.columns))) + c for c in COLUMNS)
    out = mixed(docs, docs.columns, seed, free).where(F.col(free[3]) > 0)
    return out.withColumn(free[0], F.explode(F.sequence(F.lit(1), F.col(free[3])))).select(*docs.columns)

"""Ranked lexical search with block-max pruning over a forward index (operator 11).

Documents are cut into ranges of a few hundred. For each of these blocks the index
holds its documents' terms (the forward index) and, for each term, the most that it
adds to a score anywhere in the block. A block's bound for a query item is the sum
of its terms' maxima. Blocks are scored for an item in the order of their bounds,
in three rounds of Spark jobs: the best few, some more, and then those whose bound
still reaches the score of the last hit so far. Blocks below that are never read
for the item; nothing else is left out, so the hits are those of a full scan.

The scores are whole numbers and the same on any engine: see ``contribution`` and
``weighted``. Items are the rows of the query table, in groups of bounded size.

Defined results: null texts, and texts without a term, are no documents and no
queries; whole texts count, and a very long one makes a block of its own; equal
scores are ordered by id, null ids last, then by row; repeated rows are documents,
or items, of their own; an item without hits is absent; an empty table on either
side gives no rows; further columns do not matter, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from gradeworks.llm.common import arrow_rows, dropped, written
from gradeworks.sources.scratch import new_path

#: Fixed value: a term is a run of ASCII letters and digits and of all code points beyond ASCII. In UTF-8, with A-Z lower-cased:
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of a text whose terms are counted at once.
PIECE = 1 << 24
#: A block ends at so many documents or (document, term) pairs.
BLOCK_DOCS, BLOCK_POSTINGS = 256, 1 << 17
#: Documents that are handed to Python at once.
BATCH_DOCS = 500
#: Items that meet a block in one task, and blocks that an item scores in the first rounds.
ITEM_GROUP, ROUNDS = 512, (4, 32)
#: Distinct terms of all items that are broadcast at most; more are met by a shuffle.
SENT_TERMS = 500_000


def counted(text: bytes) -> Counter:
    """The terms of a text and how often they occur."""
    out, at = Counter(), 0
    text = text.translate(LOWER)
    while at < len(text):
        gap = GAP.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        out.update(TERM.findall(text, at, end))
        at = end
    return out


def forward_index(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``block, row, id, n, terms, tfs`` of every document with a term; a block's documents stand together."""
    docs_, postings_ = BLOCK_DOCS, BLOCK_POSTINGS

    def work(batches):
        part = TaskContext.get().partitionId() << 32
        block, row, kind = 0, 0, None
        held, size = [], 0

        def out():
            ids, ns, terms, tfs = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([part + block] * len(held), pa.int64()), pa.array(range(part + row - len(held), part + row), pa.int64()), pa.array(ids, kind), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["block", "row", "id", "n", "terms", "tfs"],
            )

        for b in batches:
            kind = b.column(0).type
            for i, t in zip(b.column(0), b.column(1).cast(pa.large_binary()), strict=True):
                found = counted(t.as_py()) if t.is_valid else None
                if not found:
                    continue
                if held and (len(held) == docs_ or size + len(found) > postings_):
                    yield out()
                    held, size, block = [], 0, block + 1
                held.append((i.as_py(), sum(found.values()), list(found), list(found.values())))
                size += len(found)
                row += 1
        if held:
            yield out()

    kind = dict(docs.dtypes)[ident]
    return docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(work, f"block long, row long, id {kind}, n long, terms array<string>, tfs array<long>")


def contribution(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What an occurrence count adds to a score for a weight of one, given its document's number of terms."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * docs // terms))


def block_maxima(forward: DataFrame, docs: int, terms: int) -> DataFrame:
    """``block, term, most, df``: each term's largest contribution and its documents in a block.

    A block whose rows are read in two tasks has two rows a term: the documents add
    up, and the sum of both maxima is a bound as well.
    """

    def maxima(t: pa.Table):
        lists = t["terms"].combine_chunks()
        many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        tf = t["tfs"].combine_chunks().flatten().to_numpy()
        most = contribution(tf, np.repeat(t["n"].to_numpy(), many), docs, terms)
        flat = pa.table({"block": np.repeat(t["block"].to_numpy(), many), "term": lists.flatten(), "most": most})
        got = flat.group_by(["block", "term"], use_threads=False).aggregate([("most", "max"), ("most", "count")])
        return got.select(["block", "term", "most_max", "most_count"]).rename_columns(["block", "term", "most", "df"]).to_batches(max_chunksize=50_000)

    def work(batches):
        held = None  # the last block may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            block = t["block"].to_numpy()
            others = np.flatnonzero(block != block[-1])
            whole = int(others[-1]) + 1 if len(others) else 0
            if whole:
                yield from maxima(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None:
            yield from maxima(held)

    return forward.select("block", "n", "terms", "tfs").mapInArrow(work, "block long, term string, most long, df long")


@dataclass
class Index:
    """A searchable table: its forward index, its block maxima, and the counts that scores need."""

    forward: DataFrame
    maxima: DataFrame
    docs: int
    terms: int


def totals(forward: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""
    got = forward.agg(F.count("*"), F.sum("n")).first()
    return got[0], got[1] or 0


def built(docs: DataFrame, path: str | None = None, ident: str = "doc_id", text: str = "text") -> Index:
    """Index a table; with ``path`` the index stays there for ``opened``."""
    spark = docs.sparkSession
    path = path or new_path(spark, "search")
    with arrow_rows(spark, BATCH_DOCS):
        forward_index(docs, ident, text).write.parquet(f"{path}/forward")
        forward = spark.read.parquet(f"{path}/forward")
        block_maxima(forward, *(n := totals(forward))).write.parquet(f"{path}/maxima")
    return Index(forward, spark.read.parquet(f"{path}/maxima"), *n)


def opened(spark: SparkSession, path: str) -> Index:
    forward = spark.read.parquet(f"{path}/forward")
    return Index(forward, spark.read.parquet(f"{path}/maxima"), *totals(forward))


def asked_for(items: DataFrame) -> DataFrame:
    """``item, term, times``: the items' terms, and how often each is asked for."""
    return items.select(F.col("row").alias("item"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))


def maxima_of(index: Index, asked: DataFrame) -> DataFrame:
    """The block maxima of the terms that are asked for. Terms are sent to every task only where a count shows that they are few."""
    terms = written(asked.select("term").distinct(), "search-terms")
    few = terms.count() <= SENT_TERMS
    return written(index.maxima.join(F.broadcast(terms) if few else terms, "term", "left_semi"), "search-maxima")


def weighted(index: Index, asked: DataFrame, maxima: DataFrame) -> DataFrame:
    """``item, term, weight`` of the items' terms that the index has; a term that an item repeats weighs as often."""
    held = maxima.groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return asked.join(held, "term").select("item", "term", (w * F.col("times")).alias("weight")).where("weight > 0")


def scored(index: Index, pairs: DataFrame, lists: DataFrame, groups: int, k: int) -> DataFrame:
    """``item, row, id, score`` of the best ``k`` documents (and those that tie with the last) of each pair of item and block, none below ``least``."""
    docs, terms = index.docs, index.terms
    group = F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")
    wanted = pairs.join(lists, "item").select("block", group.alias("g"), "item", "least", "asked", "weights")
    blocks = index.forward.join(pairs.select("block", group.alias("g")).distinct(), "block").select("block", "g", "row", "id", "n", "terms", "tfs")
    kind = dict(index.forward.dtypes)["id"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = right["asked"].combine_chunks()
        known = pc.unique(asked.flatten())
        lists_, tf = left["terms"].combine_chunks(), left["tfs"].combine_chunks().flatten().to_numpy()
        many = pc.list_value_length(lists_).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(many)), many)
        term = pc.index_in(lists_.flatten(), value_set=known).fill_null(-1).to_numpy()
        hit = term >= 0
        doc, term, tf = doc[hit], term[hit], tf[hit]
        adds = contribution(tf, left["n"].to_numpy()[doc], docs, terms)
        met, starts = np.unique(doc, return_index=True)  # postings stand by document
        places = pc.index_in(asked.flatten(), value_set=known).to_numpy()
        weights, ends = right["weights"].combine_chunks().flatten().to_numpy(), np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False))
        of_term, found = np.zeros(len(known), dtype=np.int64), []
        for i, least in enumerate(right["least"].to_numpy()):
            own = slice(ends[i - 1] if i else 0, ends[i])
            of_term[places[own]] = weights[own]
            scores = np.add.reduceat(of_term[term] * adds, starts) if len(starts) else np.zeros(0, dtype=np.int64)
            of_term[places[own]] = 0
            good = np.flatnonzero(scores >= least)
            if len(good) > k:
                last = np.partition(scores[good], len(good) - k)[len(good) - k]
                good = good[scores[good] >= last]
            found.append((np.full(len(good), i), met[good], scores[good]))
        i, d, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"item": right["item"].take(pa.array(i)), "row": left["row"].take(pa.array(d)), "id": left["id"].take(pa.array(d)), "score": s})

    return blocks.groupBy("block", "g").cogroup(wanted.groupBy("block", "g")).applyInArrow(work, f"item long, row long, id {kind}, score long")


def best(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each item with their rank; tasks keep ``k`` of each before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(index: Index, queries: DataFrame, k: int = 20, ident: str = "item_id", text: str = "text", rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best documents of every row of ``queries``, in all columns but ``rank`` as scored."""
    with arrow_rows(queries.sparkSession, BATCH_DOCS):
        items = written(forward_index(queries, ident, text).drop("block"), "search-items")
    asked = asked_for(items)
    maxima = maxima_of(index, asked)
    weights = written(weighted(index, asked, maxima), "search-weights")
    lists = weights.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("item", F.col("t.term").alias("asked"), F.col("t.weight").alias("weights"))
    lists = written(lists, "search-lists")
    bound = maxima.join(weights, "term").groupBy("item", "block").agg(F.sum(F.col("most") * F.col("weight")).alias("bound")).where("bound > 0")
    bounds = written(bound, "search-bounds")
    groups = max(1, -(-lists.count() // ITEM_GROUP))
    hits = done = None
    for most in (*rounds, None):
        left = bounds.withColumn("least", F.lit(1).cast("long"))
        if hits is not None:
            full = hits.groupBy("item").agg(F.min("score").alias("s"), F.count("*").alias("c")).where(F.col("c") >= k).select("item", "s")
            left = left.join(full, "item", "left").withColumn("least", F.coalesce("s", "least")).where("bound >= least").drop("s").join(done, ["item", "block"], "left_anti")
        if most is not None:
            order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
            left = left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
        pairs = written(left.select("item", "block", "least"), "search-pairs")
        new = scored(index, pairs, lists, groups, k)
        before, hits = hits, written(best(new if hits is None else hits.drop("rank").unionByName(new), k), "search-hits")
        seen = pairs.select("item", "block")
        if before is not None:
            dropped(before)
        done = seen if done is None else done.union(seen)
    return hits.join(items.select(F.col("row").alias("item"), F.col("id").alias("query_id")), "item").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")

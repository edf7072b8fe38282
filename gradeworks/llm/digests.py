"""Exact dedup against a persistent index of digests (operator 12).

The index is a table of SHA-256 digests, bucketed and sorted by digest, with one
folder for each batch that was taken in. A new batch is reduced to one row a
digest before it is shuffled, meets the buckets of earlier batches by a sort-merge
anti-join, and what they lack is appended as its own folder. The index is never
shuffled or rewritten. A batch that is taken in again, say after a lost driver,
does not see its own folder and writes it anew, so the result is the same.

Texts are equal when they are identical after white space is deleted. Of equal
texts the row with the most code points stays, then that with the least id. A later
batch may bring a better row: with ``better`` its digest is appended once more, and
the best entry of a digest counts; without it what earlier batches hold stays.

Defined results: a null text is an empty one, and texts of white space alone equal
it; null ids come after all others, and of rows that are equal in length and id one
stays; whole texts count, however long; an empty table adds an empty batch; further
columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm.common import dropped, fresh, written
from gradeworks.sources.scratch import new_path

#: Fixed value: white space that does not count, deleted from a text before it is compared.
BLANKS = " \t\n\x0b\x0c\r"
#: Digests that a bucket of a new index is meant to hold; their number is set by the first batch.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 16


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256))


def digested(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``digest, n_chars, id, row`` of every document, written once so that row numbers hold."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(digest(F.col(text)).alias("digest"), F.length(whole).cast("long").alias("n_chars"), F.col(ident).alias("id"), F.monotonically_increasing_id().alias("row"))
    return written(rows, "digests")


def place(n_chars: str, ident: str, batch: str, row: str) -> Column:
    """What orders equal texts; the least is the best."""
    return F.struct((-F.col(n_chars)).alias("shorter"), F.col(ident).isNull().alias("no_id"), F.col(ident).alias("id"), F.col(batch).alias("batch"), F.col(row).alias("row"))


class Index:
    """The table of digests under a path; its number of buckets is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", rows: int = 0):
        self.spark = spark
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        made = [int(name.split("-")[1]) for name in there if name.startswith("buckets-")]
        self.buckets = made[0] if made else max(LEAST_BUCKETS, 2 ** math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)))
        self.path = f"{path.rstrip('/')}/buckets-{self.buckets}"
        self.table = f"digests_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, n_chars BIGINT, id {id_type}, row BIGINT, batch INT) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        if made:
            spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")  # batches that other sessions took in

    def before(self, batch: int) -> DataFrame:
        """Entries of earlier batches, bucket by bucket."""
        return self.spark.table(self.table).where(F.col("batch") < batch)

    def unshuffled(self) -> DataFrame:
        """All entries, read without their buckets, so that a join of theirs can be dealt as its sizes ask."""
        return self.spark.read.schema(self.spark.table(self.table).schema).parquet(self.path)

    def take_in(self, told: DataFrame, batch: int, better: bool = True) -> None:
        """Append the batch's digests that earlier batches lack, or, with ``better``, hold by a lesser row only."""
        best = told.groupBy("digest").agg(F.min(place("n_chars", "id", "batch", "row")).alias("best"))
        seen = self.before(batch).select(F.col("digest").alias("known"), place("n_chars", "id", "batch", "row").alias("place"))
        same = F.col("digest") == F.col("known")
        new = best.join(seen.hint("merge"), same & (F.col("place") <= F.col("best")) if better else same, "left_anti")
        entries = new.select("digest", (-F.col("best.shorter")).alias("n_chars"), "best.id", "best.row", F.lit(batch).alias("batch"))
        mode, conf = "spark.sql.sources.partitionOverwriteMode", self.spark.conf
        was = conf.get(mode)
        conf.set(mode, "dynamic")  # only this batch's folder is replaced
        try:
            entries.write.insertInto(self.table, overwrite=True)
        finally:
            conf.set(mode, was)

    def best(self) -> DataFrame:
        """``digest, best``: the entry of each digest that counts."""
        return self.unshuffled().groupBy("digest").agg(F.min(place("n_chars", "id", "batch", "row")).alias("best"))

    def closed(self) -> None:
        """Forget the table's name in this session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def verdicts(told: DataFrame, index: Index) -> DataFrame:
    """``id, row, batch, keep_id, group_size, kept, digest`` of every row of ``told`` (with its batches).

    Group sizes are counted before they are shuffled. Rows come to their group by
    a join that Spark can split where one digest has very many.
    """
    sizes = told.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = written(sizes.join(index.best(), "digest").select("digest", "group_size", "best"), "digest-groups")
    mine = (F.col("best.batch") == F.col("batch")) & (F.col("best.row") == F.col("row"))
    return told.join(groups, "digest").select("id", "row", "batch", F.col("best.id").alias("keep_id"), "group_size", mine.alias("kept"), "digest")


def judged(docs: DataFrame, path: str | None = None, arrivals: int = 2, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The verdicts on a whole table that comes in several batches, every row in one of them by the hash of its id and text's length.

    The result does not depend on how many batches there are, or on who comes first.
    """
    spark = docs.sparkSession
    told = digested(docs, ident, text).withColumn("batch", F.pmod(F.xxhash64("id", "n_chars"), F.lit(arrivals)).cast("int"))
    index = Index(spark, path or new_path(spark, "digest-index"), dict(told.dtypes)["id"], told.count())
    for batch in range(arrivals):
        index.take_in(told.where(F.col("batch") == batch), batch)
    out = verdicts(told, index)
    index.closed()
    return out


def deduplicated(docs: DataFrame, path: str, batch: int, better: bool = False, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of a batch whose text no earlier batch in the index at ``path`` holds, one for each text, with the columns of ``docs``.

    The batch is then part of the index. With ``better``, longer copies of texts
    that are in the index stay as well.
    """
    spark, (row,) = docs.sparkSession, fresh(docs, "__row")
    whole = written(docs.withColumn(row, F.monotonically_increasing_id()), "arrived")
    told = whole.select(digest(F.col(text)).alias("digest"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), F.col(ident).alias("id"), F.col(row).alias("row")).withColumn("batch", F.lit(batch))
    told = written(told, "digests")
    index = Index(spark, path, dict(told.dtypes)["id"], told.count())
    index.take_in(told, batch, better)
    stay = index.unshuffled().where(F.col("batch") == batch).select(F.col("row").alias(row))
    index.closed()
    dropped(told)
    return whole.join(stay, row, "left_semi").drop(row).select(docs.columns)

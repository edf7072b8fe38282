"""Scratch tables in the shared folder, connected components, and column helpers."""

from __future__ import annotations

import gc
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.sources.scratch import new_path

#: Fixed value: a word is a run of code points outside space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder, which lost executors do not take along."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs that are run meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no plan needs any more: it acts when the driver collects garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names with as many underscores before them as it takes to be new to the table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of a link table ``(u, v)`` as ``(id, component)``.

    ``component`` is the least id that is reachable. Ids without a link are
    absent. Each round runs a large-star step (every neighbour above a node is
    linked to the least of its neighbourhood) and a small-star step (the same
    for neighbours below it), until the links are stars. Minima are combined
    before they are shuffled and come back by a join whose large partitions
    Spark can split, so a hub with very many links is no single task's work.
    A round's links are written to the shared folder and the previous round's
    are deleted.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    links = written(edges.where("u <> v").select(low.alias("u"), high.alias("v")).distinct(), label)
    for _ in range(most_rounds):
        # settled: nobody is both a centre and a member, or a member of two
        roles = links.select(F.col("u").alias("x"), F.lit(1).alias("c"), F.lit(0).alias("m")).union(links.select("v", F.lit(0), F.lit(1)))
        if not roles.groupBy("x").agg(F.max("c").alias("c"), F.sum("m").alias("m")).where("c = 1 AND m > 0 OR m > 1").limit(1).count():
            break
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = large.where("v < u")
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            below.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
            .where("e.a <> e.b")
            .select(F.col("e.b").alias("u"), F.col("e.a").alias("v"))
            .distinct()
        )
        after = written(small, label)
        dropped(links)
        links = after
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    # settled links are stars around the least id
    found = links.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return found.union(links.select(F.col("u").alias("id"), F.col("u").alias("component"))).distinct()


#: Ranks by which a bucket's hub is chosen: buckets with many nodes in common get one of four hubs.
TURNS = (0, 0x5A3C6B1D2E4F7081, -0x1E2D3C4B5A697887, 0x33CC55AA0FF0A55A)


#: Members of a bucket up to which its pairs that are still apart are made by a join, where ``wide`` is there for the larger ones.
SMALL_BUCKET = 64


def same_group(members: DataFrame, near: Callable, verify: Callable, label: str, pairs: DataFrame | None = None, rounds: int = 2, wide: Callable | None = None) -> DataFrame:
    """``id, component`` of the nodes that have a link, from ``members`` (bucket, node and further long columns).

    Nodes of a bucket are candidates where ``near`` says so of their columns,
    and linked where ``verify`` keeps the pair ``(u, v)``. ``pairs`` are further
    candidates. The groups are those of all pairs of a bucket, without comparing
    all: one node of a bucket (the hub) is compared with every other, groups
    follow from the verified links, and then another hub outside the first one's
    group is compared with what is not yet in its own. Only nodes that are still
    apart from the last hub's group are then compared with all nodes of other
    groups. Pairs within a group cannot change the groups. A hub is found by an
    aggregate that combines before its shuffle.

    ``wide`` takes the members that are left (bucket, node, further columns, ``g``
    for the group, and ``apart``) of buckets with more than ``SMALL_BUCKET`` of them,
    and returns links that make the same groups as all their pairs would.
    """
    attrs = [c for c in members.columns if c not in ("bucket", "node")]
    told = written(members.withColumn("g", F.col("node")).withColumn("apart", F.lit(True)), f"{label}-members")
    labels = None

    def settled(links: DataFrame) -> DataFrame:
        nonlocal labels
        if labels is not None:
            links = links.union(labels.select("component", "id"))
        after = written(components(links, label), f"{label}-labels")
        if labels is not None:
            dropped(labels)
        labels = after
        return after

    def ordered(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]

    for turn in range(rounds):
        if turn and not told.limit(1).count():
            return labels
        rank = F.col("node").bitwiseXOR(F.get(F.array(*map(F.lit, TURNS)), F.pmod(F.col("bucket") + turn, F.lit(4)).cast("int")))
        hubs = told.where("apart").groupBy("bucket").agg(*[F.min_by(c, rank).alias(f"hub_{c}") for c in ("node", "g", *attrs)])
        hubs = written(hubs, f"{label}-hubs")
        other = {c: F.col(f"hub_{c}") for c in attrs}
        met = told.join(hubs, "bucket").where((F.col("g") != F.col("hub_g")) & near({c: F.col(c) for c in attrs}, other)).select(*ordered("node", "hub_node"))
        links = verify(met if turn or pairs is None else met.union(pairs))
        new = settled(links)
        of = lambda c, name: new.select(F.col("id").alias(c), F.col("component").alias(name))  # noqa: B023, E731
        now = told.drop("g", "apart").join(hubs.select("bucket", "hub_node"), "bucket").join(of("node", "g"), "node", "left").join(of("hub_node", "hub_g"), "hub_node", "left")
        now = now.withColumns({"g": F.coalesce("g", "node"), "hub_g": F.coalesce("hub_g", "hub_node")}).withColumn("apart", F.col("g") != F.col("hub_g"))
        now = written(now.select("bucket", "node", *attrs, "g", "apart"), f"{label}-members")
        open_ = now.where("apart").select("bucket").distinct()
        after = written(now.join(open_, "bucket", "left_semi"), f"{label}-members")
        for t in (told, hubs, now, links):
            dropped(t)
        told = after
    if not told.limit(1).count():
        return labels
    if wide is not None:
        sizes = told.groupBy("bucket").count().where(F.col("count") > SMALL_BUCKET).select("bucket")
        more = written(wide(told.join(sizes, "bucket", "left_semi")), f"{label}-wide")
        if more.limit(1).count():
            settled(more)
        dropped(more)
        after = written(told.join(sizes, "bucket", "left_anti"), f"{label}-members")
        dropped(told)
        told = after
    left = told.where("apart").select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("node", "g", *attrs)])
    # of two that are both apart, each meets the other: they are listed once
    rest = told.join(left, "bucket").where((F.col("g") != F.col("other_g")) & near({c: F.col(c) for c in attrs}, {c: F.col(f"other_{c}") for c in attrs}))
    more = verify(rest.select(*ordered("node", "other_node")))
    if more.limit(1).count():
        settled(more)
    for t in (told, more):
        dropped(t)
    return labels

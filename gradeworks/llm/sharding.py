"""Sharding by fixed virtual slots (operator 9).

Records hash into thousands of slots that never change. Bytes are summed for
each slot, and a versioned table says which shard holds which slot. Moving a
slot is an edit of that table, saved as its next version: no record is hashed
anew. With ``map_path`` the latest version there is loaded; it is kept as long as
it suits the sizes and the number of shards, and else edited.

Defined results: a null text has no bytes and counts 8; null ids hash like any
other value; repeated rows share a slot, unless there are more copies than shards
and they hold more than a twentieth of a shard: then the copies are dealt over
slots, by a number (``sharded``) or by their place in the table (``with_shard``,
which moves no texts); of equal rows it is open which comes first; the length of a
text does not matter; an empty table gives an empty map of zero bytes; further
columns are left alone.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeworks.llm.common import fresh, written
from gradeworks.sources.scratch import new_path

SLOTS = 8192
#: How far the fullest shard may be above the mean before a stored map is edited.
SLACK = 0.05
#: Records whose copies hold more than a shard's share of all bytes divided by this are dealt over slots.
COPIES = 20
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long, first long"


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def record(docs: DataFrame) -> Column:
    """What tells records apart, as a hash of id and text."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def heavy(sized: DataFrame, shards: int) -> DataFrame:
    """``r``: the records with more copies than there are shards that hold more than a twentieth of a shard; there are fewer than twenty a shard."""
    total = sized.agg(F.sum("size")).first()[0] or 0
    return sized.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("n") > shards) & (F.col("b") > total / shards / COPIES)).select("r")


def dealt(df: DataFrame, hot: DataFrame, key: str, name: str, slots: int) -> DataFrame:
    """``df`` with the slot of its record hash ``key``; copies of a heavy record each get that of the hash and their place in the table."""
    place, is_hot = fresh(df, "own_place", "own_heavy")
    row = F.monotonically_increasing_id()
    marked = df.withColumn(place, row * 31 + F.shiftright(row, 33)).join(F.broadcast(hot.select(F.col("r").alias(key), F.lit(True).alias(is_hot))), key, "left")
    slot = F.when(F.col(is_hot), F.pmod(F.xxhash64(key, place), F.lit(slots))).otherwise(F.pmod(key, F.lit(slots))).cast("int")
    return marked.withColumn(name, slot).drop(place, is_hot)


def numbered(read: DataFrame, hot: DataFrame, slots: int) -> DataFrame:
    """``read`` with its slots ``v``. Copies of a heavy record are numbered from 0, so that it does not matter how the table is partitioned.

    A copy's number is its rank among those of its partition, plus those of the
    partitions before: no task ranks all copies.
    """
    marked = read.join(F.broadcast(hot.withColumn("heavy", F.lit(True))), "r", "left")
    rest = marked.where("heavy is null").withColumn("v", F.pmod("r", F.lit(slots)).cast("int"))
    copies = marked.where("heavy").withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    copies = written(copies, "copies")
    many = copies.groupBy("r", "part").agg(F.count("*").alias("c"))
    before = many.withColumn("before", F.sum("c").over(Window.partitionBy("r").orderBy("part")) - F.col("c")).drop("c")
    ranked = copies.withColumn("k", F.row_number().over(Window.partitionBy("r", "part").orderBy("row"))).join(before, ["r", "part"])
    copies = ranked.withColumn("v", F.pmod(F.xxhash64("r", F.col("before") + F.col("k")), F.lit(slots)).cast("int"))
    names = [*read.columns, "v"]
    return rest.select(names).unionByName(copies.select(names))


def slot_sizes(sized: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the used slots; at most the fixed number of slots comes to the driver."""
    got = sized.groupBy("v").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return sorted((r.v, r.b, r.n) for r in got)


def first_map(sizes: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slots by falling size, each to the shard that has least so far; unused slots are dealt in turn."""
    heap = [(0, s) for s in range(shards)]
    shard_of = {slot: slot % shards for slot in range(slots)}
    for slot, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        shard_of[slot] = s
        heapq.heappush(heap, (load + size, s))
    return shard_of


def rebalanced(shard_of: dict[int, int], sizes: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """The next version of a map: moves few slots until sizes are near equal over ``shards`` shards.

    Slots of shards that are gone, and slots without a shard, move first; then, while it narrows the gap,
    the best fitting slot of the fullest shard goes to the emptiest.
    """
    bytes_of = {slot: size for slot, size, _ in sizes}
    after = dict(shard_of)
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    homeless = []
    after |= {slot: shards for slot, _, _ in sizes if slot not in after}
    for slot, s in sorted(after.items()):
        if s < shards:
            load[s] += bytes_of.get(slot, 0)
            held[s].add(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda x: (-bytes_of.get(x, 0), x)):
        s = load.index(min(load))
        after[slot] = s
        held[s].add(slot)
        load[s] += bytes_of.get(slot, 0)
    while True:
        full, free = load.index(max(load)), load.index(min(load))
        gap = load[full] - load[free]
        fits = [(abs(gap - 2 * b), slot) for slot in held[full] if 0 < (b := bytes_of.get(slot, 0)) < gap]
        if not fits or gap <= sum(load) / shards * 0.001:
            return after
        _, slot = min(fits)
        held[full].remove(slot)
        held[free].add(slot)
        load[full] -= bytes_of[slot]
        load[free] += bytes_of[slot]
        after[slot] = free


def versions(spark, map_path: str) -> list[int]:
    """The versions of a map that were written completely, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(map_path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    whole = [f.getPath() for f in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in whole if p.getName().startswith("version="))


def loaded(spark, map_path: str, version: int) -> dict[int, int]:
    """Which shard holds which slot, in a stored version: a row for each slot."""
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{map_path.rstrip('/')}/version={version}").select("slot", "shard").collect()
    return {r.slot: r.shard for r in rows}


def fits(shard_of: dict[int, int], sizes: list[tuple[int, int, int]], shards: int) -> bool:
    """Whether a map holds every used slot in the shards there are, none of them much above the mean."""
    if max(shard_of.values(), default=-1) != shards - 1 or any(slot not in shard_of for slot, _, _ in sizes):
        return False
    load = [0] * shards
    for slot, size, _ in sizes:
        load[shard_of[slot]] += size
    return max(load) <= (1 + SLACK) * sum(load) / shards


def current_map(spark, sizes: list[tuple[int, int, int]], shards: int, slots: int, map_path: str | None) -> DataFrame:
    """The map to use: the stored one, its edited next version, or a first one."""
    known = versions(spark, map_path) if map_path else []
    if not known:
        return map_table(spark, first_map(sizes, shards, slots), sizes, 1, map_path)
    before = loaded(spark, map_path, known[-1])
    after = before if fits(before, sizes, shards) else rebalanced(before, sizes, shards)
    if after == before:  # it suits, or no move of a slot makes it better
        return placed(spark, before, sizes, known[-1])
    return map_table(spark, after, sizes, known[-1] + 1, map_path)


def placed(spark, shard_of: dict[int, int], sizes: list[tuple[int, int, int]], version: int) -> DataFrame:
    """The rows of a map: a slot's shard, its bytes and rows, and ``first``, the place of its first record within the shard."""
    known = {slot: (b, n) for slot, b, n in sizes}
    at: dict[int, int] = {}
    rows = []
    for slot, shard in sorted(shard_of.items()):
        b, n = known.get(slot, (0, 0))
        rows.append((version, slot, shard, b, n, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + n
    return spark.createDataFrame(rows, MAP_SCHEMA)


def map_table(spark, shard_of: dict[int, int], sizes: list[tuple[int, int, int]], version: int = 1, map_path: str | None = None) -> DataFrame:
    """The map as a table, written under its version, in the shared folder where no path is given. A version is never overwritten.
    """
    path = f"{(map_path or new_path(spark, 'slot-map')).rstrip('/')}/version={version}"
    placed(spark, shard_of, sizes, version).coalesce(1).write.parquet(path)
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def sharded(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per record: ids, sizes, checksum, virtual slot, shard and place within the shard.

    The text is read once. A place is the record's rank within its slot plus
    the records of the shard's slots before it, so a task ranks one slot's
    records and never a whole shard. The map has as many rows as there are
    slots, so it is broadcast.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    read = written(docs.select("doc_id", record_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), record(docs).alias("r")), "read")
    sized = written(numbered(read, heavy(read, shards), slots), "sized")
    sizes = slot_sizes(sized)
    plan = current_map(spark, sizes, shards, slots, map_path)
    within = Window.partitionBy("v").orderBy("doc_id", "text_crc32", "size")
    ranked = sized.withColumn("k", F.row_number().over(within))
    return ranked.join(F.broadcast(plan.select(F.col("slot").alias("v"), "shard", "first", "version")), "v").select(
        "doc_id", "size", "text_crc32", F.col("v").alias("virtual_slot"), "shard", (F.col("first") + F.col("k") - 1).alias("slot"), F.col("version").alias("map_version")
    )


def with_shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """The records with all their columns, ``virtual_slot`` and ``shard`` (which replace columns of those names); texts are not shuffled."""
    key, slot, shard = fresh(docs, "own_key", "own_slot", "own_shard")
    told = docs.select(record_size(F.col("text")).alias("size"), record(docs).alias("r"))
    hot = written(heavy(told, shards), "heavy")
    rows = dealt(docs.withColumn(key, record(docs)), hot, key, slot, slots)
    sizes = slot_sizes(rows.select(record_size(F.col("text")).alias("size"), F.col(slot).alias("v")))
    plan = current_map(docs.sparkSession, sizes, shards, slots, map_path).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    kept = [F.col(c) for c in docs.columns if c.lower() not in ("shard", "virtual_slot")]
    return rows.join(F.broadcast(plan), slot).select(*kept, F.col(slot).alias("virtual_slot"), F.col(shard).alias("shard"))

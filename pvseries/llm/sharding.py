"""Shards through fixed virtual slots.

Each record is hashed to one of 4,096 virtual slots by its key, its text and its number among equal
records, so copies are spread over the slots too. How a table is partitioned or ordered does not
matter: a later read puts the same records into the same slots (of equal records, any may bear a
number), and a stored map can be applied to it. Copies are numbered inside their input task and
the tasks' counts are added up, so no task sees all copies of a record. Bytes are summed per slot,
and a small versioned table says which shard owns each slot. Moving data means editing that table:
a new version moves few slots and leaves the others where they are.

The table has one row per slot, a fixed number, so it is planned on the driver and broadcast.

Defined cases: a null text has size 1 and checksum 0; null keys and repeated rows are records
like any other; an empty table gives no rows and a map in which every slot has 0 bytes; other
columns of the table are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pvseries.sources.tables import materialise

SLOTS = 4_096
MAP_SCHEMA = "version int, vslot int, shard int, bytes long"


def slotted(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, part, place): records with their virtual slot."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = materialise(df.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(F.col(key).cast("long"), body, F.col(text).isNull()).alias("record"),
        F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part")), "records")
    # Counts of copies in the tasks before; records without copies have no earlier ones.
    counts = read.groupBy("record", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("record").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (counts.withColumn("earlier", F.sum("n").over(before)).where("earlier is not null")
               .select("record", "part", "earlier"))
    inside = F.row_number().over(Window.partitionBy("record", "part").orderBy("place"))
    number = F.coalesce("earlier", F.lit(0)) + F.col("inside")
    return (read.withColumn("inside", inside).join(earlier, ["record", "part"], "left")
            .withColumn("vslot", F.pmod(F.xxhash64("record", number), F.lit(slots)).cast("int"))
            .select("doc_id", "size", "text_crc32", "vslot", "part", "place"))


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes per virtual slot; the result has ``slots`` entries whatever the table's size."""
    found = {r["vslot"]: r["bytes"] for r in records.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}
    return [found.get(s, 0) for s in range(slots)]


def plan(sizes: list[int], shards: int) -> list[int]:
    """Shard of each slot: largest slot first, always to the lightest shard."""
    load = [(0, 0, s) for s in range(shards)]
    owner = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        held, count, shard = heapq.heappop(load)
        owner[slot] = shard
        heapq.heappush(load, (held + sizes[slot], count + 1, shard))
    return owner


def grow(sizes: list[int], owner: list[int], shards: int) -> list[int]:
    """The map with one shard more: slots move to the new shard only, until it has its share."""
    out, load = list(owner), [0] * (shards + 1)
    for slot, shard in enumerate(owner):
        load[shard] += sizes[slot]
    share = sum(sizes) / (shards + 1)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        giver = out[slot]
        if load[shards] + sizes[slot] <= share and load[giver] - sizes[slot] >= share - sizes[slot] / 2:
            load[giver] -= sizes[slot]
            load[shards] += sizes[slot]
            out[slot] = shards
    return out


def map_table(spark: SparkSession, versions: list[list[int]], sizes: list[int]) -> DataFrame:
    """The stored slot-to-shard map with all versions."""
    return spark.createDataFrame([(v, slot, shard, sizes[slot]) for v, owner in enumerate(versions, 1)
                                  for slot, shard in enumerate(owner)], MAP_SCHEMA)


def assign(records: DataFrame, slot_map: DataFrame, version: int) -> DataFrame:
    """Adds (shard, slot) under one version of the map; ``slot`` counts a shard's rows from 0.

    Rows are numbered inside (shard, input task), and the tasks' counts are added up per shard,
    so no task sees a whole shard.
    """
    owner = slot_map.where(F.col("version") == version).select("vslot", "shard")
    held = records.join(F.broadcast(owner), "vslot")
    inside = Window.partitionBy("shard", "part").orderBy("place")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (held.withColumn("inside", F.row_number().over(inside)).join(offsets, ["shard", "part"])
            .withColumn("slot", F.col("offset") + F.col("inside") - 1).drop("inside", "offset"))


def shard_documents(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(assigned records under version 1, slot map with version 1 and the version for one more shard)."""
    records = materialise(slotted(df, key, text), "slots")
    sizes = slot_bytes(records)
    first = plan(sizes, shards)
    slot_map = materialise(map_table(df.sparkSession, [first, grow(sizes, first, shards)], sizes), "slot-map")
    return assign(records, slot_map, 1), slot_map

"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots, bytes are added up per slot, and a small
versioned table maps slots to shards.  Rebalancing edits that table: it writes a new
version in which as few slots as possible moved; records never change their slot.
The law that holds is ``bytes``: the shards' sizes are near equal.

Everything is DataFrame operations.  Only the slot table (``slots`` rows, whatever the
corpus) is ever folded in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.session import scratch_path

SLOTS = 4096
SHARDS = 8
LAW = "bytes"


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(id_column: Column, crc: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record: the hash of its id; records without an id go by their text's checksum."""
    return F.pmod(F.xxhash64(F.coalesce(id_column.cast("string"), F.concat(F.lit("text "), crc.cast("string")))), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``vslot``, ``bytes``, ``rows`` of every slot, empty ones included."""
    found = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").fillna(0, ["bytes", "rows"])


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1 knows no sizes: slots go round the shards."""
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map edited for measured sizes; ``shards`` may be larger than before.

    Slots are taken by falling size.  A slot stays where it is while its shard keeps within
    an even share, else it goes to the shard that has least so far; so no shard exceeds the even
    share by more than one of the slots placed last.  Slots of shards that no longer exist move.
    """
    rows = slot_map.join(sizes, "vslot").agg(
        F.sum("bytes").alias("total"),
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("vslot"), F.col("shard")))).alias("slots"))
    share = F.ceil(F.col("total") / shards)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("held"),
                     F.array().cast("array<struct<vslot:int,shard:int>>").alias("placed"))

    def place(state: Column, slot: Column) -> Column:
        held = state["held"]
        stays = (slot["shard"] < shards) & (F.get(held, slot["shard"]) - slot["less"] <= share)
        least = (F.array_position(held, F.array_min(held)) - 1).cast("int")
        shard = F.when(stays, slot["shard"]).otherwise(least)
        return F.struct(
            F.transform(held, lambda b, i: F.when(i == shard, b - slot["less"]).otherwise(b)).alias("held"),
            F.concat(state["placed"], F.array(F.struct(slot["vslot"].alias("vslot"), shard.alias("shard")))).alias("placed"))

    folded = rows.select(F.aggregate("slots", start, place)["placed"].alias("placed"))
    return folded.select(F.inline("placed"))


def grown(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The map with one more shard (number ``shards``), which takes slots only into itself.

    From each old shard the slots of a fixed order (hash of the slot) go over until the
    new one has its even share of that shard's bytes.
    """
    order = Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot")
    tagged = slot_map.join(sizes, "vslot").select(
        "vslot", "shard", F.sum("bytes").over(order).alias("upto"),
        (F.sum("bytes").over(Window.partitionBy("shard")) / (shards + 1)).alias("due"))
    return tagged.select("vslot", F.when(F.col("upto") <= F.col("due"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


class SlotMaps:
    """Versions of the slot-to-shard map: one small Parquet folder each, never changed once written."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or scratch_path(spark, "slot-maps")

    def write(self, version: int, slot_map: DataFrame) -> None:
        slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("vslot int, shard int").parquet(f"{self.folder}/version={version}")


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: SlotMaps | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot`` for every row.

    ``slot`` is the record's place in its shard, 0, 1, 2 ... without gaps; fully equal
    rows share the places they have in any order.  Null ids sort first inside their virtual
    slot.  Version 1 of the map is written, sizes are measured, version 2 is the edited map
    that holds.  An empty table gives no rows.
    """
    maps = maps or SlotMaps(docs.sparkSession)
    records = docs.select("doc_id", record_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    records = records.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))
    sizes_at = scratch_path(docs.sparkSession, "slot-sizes")
    slot_bytes(records, slots).coalesce(1).write.parquet(sizes_at)
    sizes = docs.sparkSession.read.schema("vslot int, bytes long, rows long").parquet(sizes_at)
    maps.write(1, first_map(docs.sparkSession, slots, shards))
    maps.write(2, rebalanced(maps.read(1), sizes, shards))
    # The slots of a shard follow each other; a record's place is its slot's start plus its rank there.
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = maps.read(2).join(sizes.select("vslot", "rows"), "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("rank", F.row_number().over(inside)).join(starts, "vslot")
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                         (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                         F.col("vslot").alias("virtual_slot"))

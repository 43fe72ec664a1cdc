"""Sharding by fixed virtual slots (operator 1); DataFrame functions only.

Records are hashed into a fixed number of virtual slots. The bytes of each slot are summed, and a table that is kept in
versions says which shard holds a slot. Rebalancing edits that table: it moves as few slots as bring the shards to equal
bytes; a record never changes its slot.

Nulls: a null text has no bytes and the CRC of the empty text; a null doc_id is hashed like a value, together with the
text. Equal rows share a slot. Empty table: no rows, and a map without moves. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.llm._store import crc, shared_dir

#: Bytes that each record takes besides its text.
RECORD = 16


def records(documents: DataFrame, slots: int) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents.select("doc_id", (F.octet_length(text) + RECORD).cast("long").alias("size"), crc(text).alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(recs: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot: as many rows as there are slots, however many records."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def initial_map(spark: SparkSession, slots: int, shards: int) -> DataFrame:
    """Version 0 of the map: slots dealt to the shards in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).alias("version"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int, keep: float = 0.9) -> DataFrame:
    """The next version of the map. A shard keeps its largest slots up to `keep` of an even share; the others move, the
    largest first, each to the shard that has least by then. The fold runs over one row per slot, a fixed number."""
    even = F.sum("bytes").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / shards
    held = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    known = slot_map.join(sizes.select("virtual_slot", "bytes"), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    known = known.withColumn("stays", (held <= keep * even) & (F.col("shard") < shards))
    each = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "shard", "stays", "version")))
    start = F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("each", lambda x: x["stays"] & (x["shard"] == s)), F.lit(0).cast("long"), lambda a, x: a - x["minus"])).alias("loads"),
        F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("placed"),
    )

    def place(state, x):
        least = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(state["loads"], lambda load, i: F.when(i == least, load - x["minus"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(state["placed"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), least.alias("shard")))).alias("placed"))

    folded = known.groupBy().agg(each.alias("each")).select("each", F.aggregate(F.filter("each", lambda x: ~x["stays"]), start, place)["placed"].alias("placed"))
    version = F.coalesce(F.array_max(F.transform("each", lambda x: x["version"])), F.lit(0)) + 1
    stay = F.transform(F.filter("each", lambda x: x["stays"]), lambda x: F.struct(x["virtual_slot"].alias("virtual_slot"), x["shard"].alias("shard")))
    return folded.select(version.alias("version"), F.explode(F.concat(stay, "placed")).alias("at")).select("at.virtual_slot", "at.shard", "version")


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Adds one version of the map to the table in folder; versions before it stay as they are."""
    slot_map.write.partitionBy("version").mode("append").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, version int").parquet(folder).where(F.col("version") == version)


def placed(recs: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """recs with `shard` and `slot`, the place in its shard, gapless from 0: the rows of the slots before it in the shard, then its place in its own slot."""
    before = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slot_map.join(sizes, "virtual_slot").select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return recs.withColumn("_own", own).join(starts, "virtual_slot").withColumn("slot", (F.col("_first") + F.col("_own") - 1).cast("long")).drop("_first", "_own")


def sharded(documents: DataFrame, shards: int, slots: int = 4096, folder: str | None = None) -> DataFrame:
    """Every row of documents with its virtual slot, shard and place. The map's versions are kept in folder (by default a new one in the shared folder)."""
    import uuid

    spark = documents.sparkSession
    folder = folder or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    recs = records(documents, slots)
    sizes_at = f"{folder}-sizes"
    slot_sizes(recs).write.parquet(sizes_at)
    sizes = spark.read.schema("virtual_slot int, bytes long, n_rows long").parquet(sizes_at)
    first = initial_map(spark, slots, shards)
    save_map(first, folder)
    save_map(rebalanced(load_map(spark, folder, 0), sizes, shards), folder)
    return placed(recs, load_map(spark, folder, 1), sizes)

"""Queries on tables that are brought up to date, as a whole or by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.plans.registry import query, table
from tracequarry.sources import snapshots
from tracequarry.store import shared_dir
from tracequarry.streaming import keyed


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """with a as (select c_custkey, c_name, c_mktsegment as segment, c_acctbal from customer where c_custkey % 7 > 0), b as (select c_custkey, c_name, case when c_custkey % 5 = 0 then 'NONE' else c_mktsegment end as segment, c_acctbal from customer where c_custkey % 11 > 0),
    c as (select c_custkey, c_name, null as segment, c_acctbal from customer where c_custkey % 13 = 0),
    l as (select * from b where c_custkey not in (select c_custkey from c) union all select * from c)
    select c_custkey, c_name, segment, c_acctbal, case when c_custkey in (select c_custkey from a) then segment is not distinct from (select a.segment from a where a.c_custkey = l.c_custkey) else false end as as_first from l"""
)
def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Three versions of a table of customers: a first, a second that replaces it as a whole, and a third that only inserts and updates."""
    folder, customer = _folder(spark, "customers"), table(spark, d, "customer")
    rows = lambda where, segment: customer.where(where).select("c_custkey", "c_name", segment.alias("segment"), "c_acctbal")
    snapshots.write_version(folder, rows("c_custkey % 7 > 0", F.col("c_mktsegment")), "c_custkey")
    snapshots.write_version(folder, rows("c_custkey % 11 > 0", F.when(F.col("c_custkey") % 5 == 0, "NONE").otherwise(F.col("c_mktsegment"))), "c_custkey")
    snapshots.write_version(folder, rows("c_custkey % 13 = 0", F.lit(None).cast("string")), "c_custkey", delete_missing=False)
    first = snapshots.read_version(spark, folder, 0).select("c_custkey", F.struct("segment").alias("f"))
    return snapshots.read_version(spark, folder).join(first, "c_custkey", "left").select("c_custkey", "c_name", "segment", "c_acctbal", F.coalesce(F.col("f.segment").eqNullSafe(F.col("segment")) & F.col("f").isNotNull(), F.lit(False)).alias("as_first"))


@query(
    """with e as (select event_type as source_id, user_id::varchar as external_id, ts::varchar || lpad(event_id::varchar, 12, '0') as token, sha256(floor(value)::bigint::varchar) as h, value < 5 as gone from events where user_id is not null),
    l as (select source_id, external_id, arg_max(h, (token, gone)) as content_hash, arg_max(gone, (token, gone)) as gone, count(*) as n from e group by all)
    select source_id, external_id, not gone as active, case when gone then '' else content_hash end as content_hash from l"""
)
def keyed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions of documents, streamed into state by source and key in two goes; what counts at the end, of each that was ever there."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before, folder, events = spark.conf.get(name, None), _folder(spark, "events"), table(spark, d, "events")
    token = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    rows = lambda df: df.select(F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("external_id"), F.when(F.col("value") >= 5, F.sha2(F.floor("value").cast("string"), 256)).alias("content_hash"), token.alias("version_token"), (F.col("value") < 5).alias("deleted"))
    spark.conf.set(name, keyed.ROCKSDB)
    try:
        for part in (1, 0):  # the later half lands when the first query has ended; a second one goes on with its state
            events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            keyed.ingest(rows(stream), f"{folder}/actions", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    last = spark.read.schema(keyed.ACTIONS).parquet(f"{folder}/actions")
    best = last.groupBy("source_id", "external_id").agg(F.max(F.struct("version_token", "action", "content_hash")).alias("l"))
    gone = F.col("l.content_hash") == ""
    return best.select("source_id", "external_id", (~gone).alias("active"), F.col("l.content_hash").alias("content_hash"))

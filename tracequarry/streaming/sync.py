"""Incremental ingestion by hash or cursor: one batch as a DataFrame, a stream as foreachBatch over the same function."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def actions(incoming: DataFrame, checkpoint: DataFrame, complete: bool = True, owner: str | None = None) -> DataFrame:
    """external_id, content_hash and action of a scan against a checkpoint (external_id, content_hash, status, source_id).

    CREATED, UPDATED, REACTIVATED, SKIPPED; DEACTIVATED for what is missing, only after a complete scan and only of the scan's
    own owner, else KEPT. Of rows with one id the last by version_token counts, of equal ones the greatest hash.
    """
    now = incoming.groupBy("external_id").agg(F.max(F.struct("version_token", "content_hash"))["content_hash"].alias("new_hash"))
    was = checkpoint.select("external_id", F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"), "source_id")
    both = now.join(was, "external_id", "full_outer")
    mine = F.lit(True) if owner is None else F.col("source_id") == owner
    action = (
        F.when(F.col("old_hash").isNull(), "CREATED")
        .when(F.col("new_hash").isNull(), F.when(F.lit(complete) & mine & (F.col("old_status") == "ACTIVE"), "DEACTIVATED").otherwise("KEPT"))
        .when(F.col("new_hash") != F.col("old_hash"), "UPDATED")
        .when(F.col("old_status") != "ACTIVE", "REACTIVATED")
        .otherwise("SKIPPED")
    )
    return both.select("external_id", F.coalesce("new_hash", "old_hash").alias("content_hash"), action.alias("action"), "old_status", "source_id")


def next_checkpoint(acted: DataFrame, source_id: str) -> DataFrame:
    """The checkpoint after a batch."""
    status = F.when(F.col("action") == "DEACTIVATED", "INACTIVE").when(F.col("action") == "KEPT", F.col("old_status")).otherwise("ACTIVE")
    return acted.select("external_id", "content_hash", status.alias("status"), F.coalesce("source_id", F.lit(source_id)).alias("source_id"))


def counters(acted: DataFrame, run_id: str) -> DataFrame:
    """The audit row of a run."""
    count = lambda *kinds: F.count_if(F.col("action").isin(*kinds))
    return acted.agg(count("CREATED").alias("n_created"), count("UPDATED", "REACTIVATED").alias("n_updated"), count("SKIPPED", "KEPT").alias("n_skipped"), count("DEACTIVATED").alias("n_deactivated")).withColumn("run_id", F.lit(run_id))


def after_cursor(feed: DataFrame, cursor: DataFrame) -> DataFrame:
    """Rows of feed (source_id, version_token, ...) above their source's high-water mark (source_id, last_token); sources without one pass whole."""
    return feed.join(cursor, "source_id", "left").where(F.col("last_token").isNull() | (F.col("version_token") > F.col("last_token"))).drop("last_token")


def high_water(feed: DataFrame) -> DataFrame:
    return feed.groupBy("source_id").agg(F.max("version_token").alias("last_token"))


def replayed(versions: DataFrame, keys: list[str], batch: str, digest: str) -> DataFrame:
    """What a replay of all batches leaves: the last batch's row of each key, with how often its digest changed on the way."""
    w = Window.partitionBy(*keys).orderBy(batch)
    changed = versions.withColumn("_c", F.coalesce((F.lag(digest).over(w) != F.col(digest)).cast("int"), F.lit(0)))
    return changed.groupBy(*keys).agg(F.max(batch).alias("last_batch"), F.max_by(digest, batch).alias("content_hash"), F.sum("_c").alias("n_updates"))


def ingest(stream: DataFrame, store: str, source_id: str, checkpoint_dir: str):
    """Starts a query that keeps store/state-<batch> (checkpoint) and store/audit up to date from a stream of (external_id, content_hash, version_token).

    Each batch writes the folder of its own number, so a batch that runs again after a failure replaces its own work only.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "external_id string, content_hash string, status string, source_id string"
        before = spark.createDataFrame([], schema) if number == 0 else spark.read.schema(schema).parquet(f"{store}/state-{number - 1}")
        acted = actions(batch, before, complete=False).persist()
        next_checkpoint(acted, source_id).write.mode("overwrite").parquet(f"{store}/state-{number}")
        counters(acted, f"{source_id}-{number}").write.mode("overwrite").parquet(f"{store}/audit/batch={number}")
        acted.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()

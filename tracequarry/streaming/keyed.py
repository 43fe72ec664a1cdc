"""Incremental ingestion with state for each source and key: what a store knows of a document lives in the stream's own state, not in tables of every batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STATE = "content_hash string, version_token string, active boolean"
ACTIONS = "source_id string, external_id string, content_hash string, version_token string, action string"
#: The state store that keyed state needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Versions(StatefulProcessor):
    """The last version of one document of one source, and its high-water mark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = None  # of a batch the last by token, of equal tokens the deletion, then the greatest hash
        for part in rows:
            for token, gone, digest in zip(part["version_token"], part["deleted"], part["content_hash"], strict=True):
                if token is not None:
                    version = (token, bool(gone), digest or "")
                    best = version if best is None or version > best else best
        if best is None:
            return
        token, gone, digest = best
        was = self.last.get() if self.last.exists() else None
        if was is not None and token < was[1]:  # older than what is known
            action = "SKIPPED"
        elif gone:
            action = "DEACTIVATED" if was is not None and was[2] else "SKIPPED"
        elif was is None:
            action = "CREATED"
        elif not was[2]:
            action = "REACTIVATED" if token > was[1] else "SKIPPED"  # a deletion wins over its own token
        else:
            action = "UPDATED" if digest != was[0] else "SKIPPED"
        if was is None or token >= was[1]:
            active = (was is not None and was[2]) if action == "SKIPPED" else not gone
            hash_ = was[0] if gone and was is not None else digest
            self.last.update((hash_, token, active))
        yield pd.DataFrame({"source_id": [key[0]], "external_id": [key[1]], "content_hash": [digest], "version_token": [token], "action": [action]})

    def close(self) -> None:
        pass


def versions(stream: DataFrame) -> DataFrame:
    """(source_id, external_id, content_hash, version_token, action) for each document that a batch of a stream brings, once.

    stream(source_id, external_id, content_hash, version_token, optionally deleted), tokens compared as strings. CREATED, UPDATED, REACTIVATED, DEACTIVATED or SKIPPED, against the last version
    that the document's own state holds; older tokens change nothing, so batches may come late or twice. State is one value for each document
    and grows with these alone. Rows without a source, an id or a token count for nothing. Needs the state store ROCKSDB."""
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in stream.columns else F.lit(False)
    rows = stream.where("source_id is not null and external_id is not null and version_token is not null")
    rows = rows.select("source_id", "external_id", "content_hash", F.col("version_token").cast("string"), deleted.alias("deleted"))
    return rows.groupBy("source_id", "external_id").transformWithStateInPandas(_Versions(), outputStructType=ACTIONS, outputMode="Append", timeMode="None")


def ingest(stream: DataFrame, out: str, checkpoint_dir: str):
    """Starts a query that appends the actions of each batch to the table at `out` (Parquet); a batch that runs again after a failure is written once."""
    return versions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint_dir).outputMode("append").trigger(availableNow=True).start()


def current(actions: DataFrame) -> DataFrame:
    """(source_id, external_id, content_hash, version_token, active): the last version of each document in a table of actions."""
    real = actions.where("action <> 'SKIPPED'")
    last = real.groupBy("source_id", "external_id").agg(F.max(F.struct("version_token", (F.col("action") == "DEACTIVATED").alias("gone"), "content_hash")).alias("l"))
    return last.select("source_id", "external_id", "l.content_hash", "l.version_token", (~F.col("l.gone")).alias("active"))


def high_water(actions: DataFrame) -> DataFrame:
    """(source_id, last_token) of a table of actions."""
    return actions.groupBy("source_id").agg(F.max("version_token").alias("last_token"))

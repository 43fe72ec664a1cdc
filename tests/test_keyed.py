"""State by source and document: what batches bring, late rows, a restart, and the size of the state."""

import glob
import os

import pytest

from tracequarry.streaming import keyed

SHAPE = "source_id string, external_id string, content_hash string, version_token string, deleted boolean"
BATCHES = [
    [("s", "a", "1", "1", None), ("s", "b", "1", "1", None), ("t", "a", "9", "1", None), (None, "a", "1", "1", None), ("s", "z", "1", None, None)],
    [("s", "a", "2", "3", None), ("s", "a", "7", "2", None), ("s", "b", "1", "2", None)],
    [("s", "a", "0", "2", None), ("s", "b", None, "3", True), ("s", "new", "1", "3", None), ("s", "gone", None, "3", True)],
    [("s", "b", "5", "4", None), ("s", "a", "2", "3", None), ("s", "gone", "4", "4", None), ("t", "a", "9", "1", True)],
]
WANT = [
    {("s", "a"): "CREATED", ("s", "b"): "CREATED", ("t", "a"): "CREATED"},
    {("s", "a"): "UPDATED", ("s", "b"): "SKIPPED"},
    {("s", "a"): "SKIPPED", ("s", "b"): "DEACTIVATED", ("s", "new"): "CREATED", ("s", "gone"): "SKIPPED"},
    {("s", "b"): "REACTIVATED", ("s", "a"): "SKIPPED", ("s", "gone"): "REACTIVATED", ("t", "a"): "DEACTIVATED"},
]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_each_start_goes_on_where_the_last_ended(rocks, tmp_path):
    base, seen = f"file://{tmp_path}", 0
    for number, batch in enumerate(BATCHES):
        rocks.createDataFrame(batch, SHAPE).coalesce(1).write.json(f"{base}/in/b={number}")
        query = keyed.ingest(rocks.readStream.schema(SHAPE).json(f"{base}/in/b=*"), f"{base}/out", f"{base}/cp")  # a new query each time: a restart
        query.awaitTermination()
        rows = rocks.read.parquet(f"{base}/out").collect()
        assert len(rows) - seen == len(WANT[number])
        seen = len(rows)
        (state,) = query.lastProgress["stateOperators"]
        assert state["numRowsTotal"] <= len({(r[0], r[1]) for b in BATCHES[: number + 1] for r in b if None not in (r[0], r[1], r[3])})
    got = sorted((r.source_id, r.external_id, r.version_token, r.action) for r in rows)
    assert got == sorted((s, e, max(r[3] for r in BATCHES[n] if r[0] == s and r[1] == e), a) for n, w in enumerate(WANT) for (s, e), a in w.items())
    # nothing new: nothing is written
    keyed.ingest(rocks.readStream.schema(SHAPE).json(f"{base}/in/b=*"), f"{base}/out", f"{base}/cp").awaitTermination()
    out = rocks.read.parquet(f"{base}/out")
    assert out.count() == seen
    last = {(r.source_id, r.external_id): (r.content_hash, r.version_token, r.active) for r in keyed.current(out).collect()}
    assert last[("s", "a")] == ("2", "3", True) and last[("s", "b")] == ("5", "4", True) and last[("t", "a")][2] is False
    assert {tuple(r) for r in keyed.high_water(out).collect()} == {("s", "4"), ("t", "1")}
    assert os.path.isdir(tmp_path / "cp") and glob.glob(str(tmp_path / "cp" / "state" / "*"))

import json

from pyspark.sql import functions as F

from tracequarry.sources import files
from tracequarry.streaming import sync


def test_folder_decodes_and_hashes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes("\ufeffgrün".encode())
    (tmp_path / "b.txt").write_bytes("grün".encode("latin-1"))
    (tmp_path / "~$b.txt").write_bytes(b"x")
    rows = files.folder(spark, f"file://{tmp_path}", "*.txt").collect()
    assert [r["text"] for r in rows] == ["grün", "grün"] and all(len(r["content_hash"]) == 64 for r in rows)


def test_suite_rows_keep_provenance(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Test ID,Scenario,Expected outcome,JIRA,Java attribute\nT1,does x,ok,CAS-2,Customer.countryCode\n,only mapping,,,x\nT2,,,,\n")
    (row,) = files.test_suite(spark, f"file://{tmp_path}/s.csv").collect()
    assert (row["test_id"], row["attribute"], row["jira"], row["execution_status"]) == ("T1", "countryCode", "CAS-2", "NOT_VERIFIED")


def test_json_cases_and_junit(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"test_cases": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3}]))
    assert files.json_cases(spark, f"file://{tmp_path}/*.json").count() == 3
    (tmp_path / "r.xml").write_text('<testsuite><testcase name="a" classname="C"/><testcase name="b" classname="C"><failure>no</failure></testcase></testsuite>')
    assert {(r["name"], r["status"]) for r in files.junit(spark, f"file://{tmp_path}/r.xml").collect()} == {("a", "PASSED"), ("b", "FAILED")}


def test_openapi(spark):
    spec = {"paths": {"/a": {"get": {"x": {"$ref": "#/components/schemas/B"}}, "parameters": []}}}
    df = spark.createDataFrame([("s", json.dumps(spec)), ("t", "broken")], "spec string, text string")
    assert [tuple(r) for r in files.openapi_operations(df).collect()] == [("s", "/a", "get", ["B"])]


def test_manifest_is_final(spark, tmp_path):
    out = f"file://{tmp_path}/m"
    files.finalise(spark.createDataFrame([("r1", 1)], "release string, n int"), ["release"], out)
    assert files.drifted(spark, out).count() == 0
    try:
        files.finalise(spark.createDataFrame([("r1", 2)], "release string, n int"), ["release"], out)
        raise SystemError("a second manifest was written")
    except Exception as error:
        assert "ALREADY_EXISTS" in str(error)


def test_actions(spark):
    now = spark.createDataFrame([("new", "1", "1"), ("same", "1", "1"), ("changed", "2", "1"), ("changed", "3", "2"), ("back", "1", "1")], "external_id string, content_hash string, version_token string")
    was = spark.createDataFrame([("same", "1", "ACTIVE", "f"), ("changed", "1", "ACTIVE", "f"), ("back", "1", "INACTIVE", "f"), ("gone", "1", "ACTIVE", "f"), ("other", "1", "ACTIVE", "g")], "external_id string, content_hash string, status string, source_id string")
    acted = lambda **k: {r["external_id"]: r["action"] for r in sync.actions(now, was, **k).collect()}
    assert acted(owner="f") == {"new": "CREATED", "same": "SKIPPED", "changed": "UPDATED", "back": "REACTIVATED", "gone": "DEACTIVATED", "other": "KEPT"}
    assert acted(complete=False)["gone"] == "KEPT"


def test_cursor(spark):
    feed = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "source_id string, version_token int")
    mark = spark.createDataFrame([("a", 1)], "source_id string, last_token int")
    assert {tuple(r) for r in sync.after_cursor(feed, mark).collect()} == {("a", 3), ("b", 2)}
    assert {tuple(r) for r in sync.high_water(feed).collect()} == {("a", 3), ("b", 2)}


def test_stream_over_batches_equals_one_batch(spark, tmp_path):
    schema = "external_id string, content_hash string, version_token string"
    batches = [[("a", "1", "1"), ("b", "1", "1")], [("a", "2", "2")], [("c", "1", "3"), ("b", "1", "3")]]
    store = f"file://{tmp_path}/store"
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"file://{tmp_path}/in/b={number}")
        stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in/b=*")
        sync.ingest(stream, store, "feed", f"file://{tmp_path}/cp").awaitTermination()
    last = spark.read.parquet(f"{store}/state-2")
    once = sync.next_checkpoint(sync.actions(spark.createDataFrame(sum(batches, []), schema), spark.createDataFrame([], last.schema)), "feed")
    pick = lambda df: sorted((r["external_id"], r["content_hash"], r["status"]) for r in df.collect())
    assert pick(last) == pick(once)
    audit = spark.read.parquet(f"{store}/audit")
    assert audit.agg(F.sum("n_created"), F.sum("n_updated"), F.sum("n_skipped")).first()[:] == (3, 1, 3)

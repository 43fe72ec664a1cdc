"""Versions of a table: update, insert, delete, a failed write, unchanged buckets, old readers."""

import pytest
from pyspark.sql import functions as F

from tracequarry.sources import snapshots

SHAPE = "id string, text string, n int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_update_insert_delete(spark, tmp_path):
    out = f"file://{tmp_path}/t"
    table = lambda items: spark.createDataFrame(items, SHAPE)
    first = [(f"k{i}", "x", i) for i in range(200)]
    got = snapshots.write_version(out, table([*first, ("k0", "w", 1)]), "id", buckets=16)
    assert got == {"version": 0, "inserted": 200, "updated": 0, "deleted": 0, "unchanged": 0, "written_buckets": 16} and rows(snapshots.read_version(spark, out)) == sorted(first, key=str)

    second = [r for r in first if r[0] != "k7"]
    second[3] = ("k3", None, 3)
    second.append(("new", None, None))
    before = snapshots.read_version(spark, out, 0)
    got = snapshots.write_version(out, table(second[::-1]), "id", buckets=16)
    assert (got["inserted"], got["updated"], got["deleted"], got["unchanged"]) == (1, 1, 1, 198) and 1 <= got["written_buckets"] <= 3
    assert rows(snapshots.read_version(spark, out)) == sorted(second, key=str) and rows(before) == sorted(first, key=str)
    assert spark.read.parquet(f"{out}/data/version=1").select("bucket").distinct().count() == got["written_buckets"]
    same = snapshots.write_version(out, table(second), "id", buckets=16)
    assert same == {"version": 1, "inserted": 0, "updated": 0, "deleted": 0, "unchanged": 200, "written_buckets": 0} and snapshots.known_versions(spark, out) == [0, 1]

    # without deletion what is missing stays
    got = snapshots.write_version(out, table([("k5", "y", 5), ("k9", "x", 9)]), "id", buckets=16, delete_missing=False)
    assert (got["version"], got["inserted"], got["updated"], got["deleted"]) == (2, 0, 1, 0)
    assert rows(snapshots.read_version(spark, out)) == sorted([("k5", "y", 5) if r[0] == "k5" else r for r in second], key=str)

    # a write that fails half-way leaves the table, and the next one writes over it
    broken = table(second).withColumn("n", F.when(F.col("id") == "k8", F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="no"):
        snapshots.write_version(out, broken, "id", buckets=16)
    table([("k1", "left behind", 0)]).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{out}/data/version=3")
    assert snapshots.known_versions(spark, out) == [0, 1, 2]
    got = snapshots.write_version(out, table([]), "id", buckets=16)
    assert (got["version"], got["deleted"]) == (3, 200) and rows(snapshots.read_version(spark, out)) == []
    assert 200 == snapshots.read_version(spark, out, 2).count()
    assert snapshots.forget(spark, out, keep=1) == [0, 1, 2, 3] and snapshots.read_version(spark, out).count() == 0
    with pytest.raises(ValueError):
        snapshots.read_version(spark, out, 0)


def test_keys_must_be_there(spark, tmp_path):
    with pytest.raises(ValueError):
        snapshots.write_version(f"file://{tmp_path}/t", spark.createDataFrame([(None, "x", 1)], SHAPE), "id")
    with pytest.raises(ValueError):
        snapshots.read_version(spark, f"file://{tmp_path}/none")

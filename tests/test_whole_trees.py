"""Trees are opened to their last level, whatever their depth."""

import json

from pyspark.sql import functions as F

from tracequarry.functions import trees
from tracequarry.plans import catalogue


def nested(value, levels):
    for k in range(levels):
        value = {"k": value} if k % 2 else [value]
    return value


def flat(v, path=""):
    if isinstance(v, dict):
        return {p: x for k, i in v.items() for p, x in flat(i, f"{path}.{k}" if path else k).items()}
    if isinstance(v, list):
        return {p: x for k, i in enumerate(v) for p, x in flat(i, f"{path}[{k}]").items()}
    return {path: json.dumps(v)}


def test_leaves_below_any_depth(spark):
    values = [{"a": nested(1, 11), "t": '}"{[[[\\'}, {"b": {}, "c": [[], "x"]}, 5, []]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k long, j string")
    assert [r[0] for r in df.orderBy("k").select(trees.depths(F.col("j"))).collect()] == [12, 3, 0, 1]
    got = {(r["k"], r["path"], r["value"]) for r in trees.leaves(df, "k", "j").collect()}
    assert got == {(k, p, v) for k, tree in enumerate(values) for p, v in flat(tree).items()}
    limited = {(r["k"], r["path"], r["value"]) for r in trees.leaves(df, "k", "j", depth=1).collect()}
    assert (0, "a", json.dumps(values[0]["a"], separators=(",", ":"))) in limited and (1, "c", '[[],"x"]') in limited


def test_differences_below_any_depth(spark):
    df = spark.createDataFrame([(1, json.dumps(nested(1, 9)), json.dumps(nested(2, 9)))], "k long, o string, n string")
    path = next(iter(flat(nested(1, 9))))
    assert [(r["path"], r["change"]) for r in trees.leaf_diff(df, "k", "o", "n").collect()] == [(path, "CHANGED")]
    assert [(r["path"], r["issue"]) for r in trees.compare(df, "k", "o", "n").collect()] == [(path, "VALUE_MISMATCH")]
    assert [(r["path"], r["issue"]) for r in trees.compare(df, "k", "o", "n", depth=3).collect()] == [("[0].k[0]", "VALUE_MISMATCH")]


def test_leaf_query_keeps_nested_properties(spark, tmp_path):
    spark.createDataFrame([(1, '{"a": {"b": {"c": [7]}}, "d": 1}')], "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in catalogue.queries()["json_leaf_flatten"](spark, str(tmp_path)).collect()}
    assert got == {(1, "a.b.c[0]", "7"), (1, "d", "1")}

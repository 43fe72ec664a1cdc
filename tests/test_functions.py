import json

from pyspark.sql import functions as F

from tracequarry.functions import text as tx
from tracequarry.functions import trees, vectors


def one(spark, expr, **values):
    df = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).alias(k) for k, v in values.items()])
    return df.select(expr.alias("x")).first()["x"]


def test_tokens_and_names(spark):
    assert one(spark, tx.search_tokens(F.col("t")), t="GET /api/x-1 Über a_b") == ["get", "/api/x-1", "ber", "a_b"]
    assert one(spark, tx.word_tokens(F.col("t"), stop=("the",)), t="the user_name") == ["user_name", "username"]
    assert one(spark, tx.camel_tokens(F.col("t")), t="countryCode") == ["country", "code", "countrycode"]
    assert one(spark, tx.accessor_attribute(F.col("t")), t="setFirstName") == "firstName" and one(spark, tx.accessor_attribute(F.col("t")), t="settle") is None
    token = tx.domain_token(F.col("t"), ("Service", "Impl", "Model"))
    assert [one(spark, token, t=t) for t in ("CustomerServiceImpl", "Service", "OrderModelMODEL", "ModelOrder", "XMLService")] == ["customer", "service", "order", "model", "xml"]
    assert one(spark, tx.tickets(F.col("t")), t="CAS-2 and XX-10, CAS-2") == ["CAS-2", "XX-10"]
    assert one(spark, tx.listed(F.col("t")), t='["a","b"]') == ["a", "b"] and one(spark, tx.listed(F.col("t")), t="a, b;c") == ["a", "b", "c"]


def test_versions_order_naturally(spark):
    df = spark.createDataFrame([(v,) for v in ("V10", "V2.1", "", "V2", "V1")], "v string")
    assert [r["v"] for r in df.orderBy(tx.version_key(F.col("v"))).collect()] == ["", "V1", "V2", "V2.1", "V10"]
    got = one(spark, tx.family_and_version(F.col("t")), t="Mapping_Customer_v2.1.xlsx")
    assert (got["family"], got["version"]) == ("MAPPING_CUSTOMER", "V2.1")


def test_endpoints_scopes_and_targets(spark):
    assert one(spark, tx.endpoint_key(F.col("t")), t="http://h:1//api/{id}/x/?q=1") == "/api/{}/x"
    assert one(spark, tx.scope_key(F.col("t")), t=" C:\\Work\\App\\ ") == "c:/work/app"
    assert [one(spark, tx.source_kind(F.col("t")), t=t) for t in ("//a/b", "$.a", "db: x", "kafka-in", "??")] == ["XML", "JSON", "DB", "KAFKA", "UNKNOWN"]
    got = one(spark, tx.owner_and_attribute(F.col("t")), t="Customer#countryCode")
    assert (got["owner"], got["attribute"]) == ("Customer", "countryCode")


def test_conditions_and_boundaries(spark):
    assert [tuple(c) for c in one(spark, tx.conditions(F.col("t")), t="if amount >= 10.5 and age<3")] == [("amount", ">=", 10.5), ("age", "<", 3.0)]
    assert [c["expected"] for c in one(spark, tx.boundary_values(F.col("v"), F.lit("<=")), v=5.0)] == [True, True, False, False]


def test_chunks_and_snippets(spark):
    cut = one(spark, tx.fixed_chunks(F.col("t"), 4, 6), t="abcdefghij")
    assert [(c["number"], c["chunk"]) for c in cut] == [(0, "abcdef"), (1, "efghij"), (2, "ij")]
    assert one(spark, tx.snippet(F.col("t"), F.array(F.lit("needle")), 5, 10), t="x" * 50 + "needle") == "xxxxxneedle"


def test_vectors(spark):
    assert abs(one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) - 0.5**0.5) < 1e-12
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) == 0.0


def test_leaves_and_signature(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": {"b": [{"c": 1}, 2]}, "e": {}, "f": None})), (2, "no json"), (3, None)], "k long, j string")
    got = {(r["path"], r["value"]) for r in trees.leaves(df, "k", "j").collect()}
    assert got == {("a.b[0].c", "1"), ("a.b[1]", "2"), ("f", "null")}
    assert one(spark, trees.signature(F.lit('{"a":1,"b":2}')), x=1) == one(spark, trees.signature(F.lit('{"b":2, "a":1}')), x=1)


def test_structural_compare(spark):
    pairs = [
        (1, {"a": 1, "b": {"c": 1}}, {"a": 1}, {("b", "MISSING_IN_ACTUAL")}),
        (2, {"a": 1}, {"a": 1, "x": {"y": 2}}, {("x", "UNEXPECTED_IN_ACTUAL")}),
        (3, {"a": 1}, {"a": "1"}, {("a", "TYPE_MISMATCH")}),
        (4, {"a": 1}, {"a": 2}, {("a", "VALUE_MISMATCH")}),
        (5, {"a": [1, 2]}, {"a": [1]}, {("a", "LIST_LENGTH_MISMATCH"), ("a[1]", "MISSING_IN_ACTUAL")}),
        (6, {"a": 1}, {"a": None}, {("a", "VALUE_MISMATCH")}),
    ]
    df = spark.createDataFrame([(k, json.dumps(e), json.dumps(a)) for k, e, a, _ in pairs], "k long, e string, a string")
    rows = trees.compare(df, "k", "e", "a").collect()
    for k, _, _, want in pairs:
        assert {(r["path"], r["issue"]) for r in rows if r["k"] == k} == want


def test_leaf_diff_is_its_own_inverse(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":2}', '{"b":3,"c":4}')], "k long, o string, n string")
    there = {(r["path"], r["change"]) for r in trees.leaf_diff(df, "k", "o", "n").collect()}
    back = {(r["path"], r["change"]) for r in trees.leaf_diff(df, "k", "n", "o").collect()}
    flip = {"ADDED": "REMOVED", "REMOVED": "ADDED", "CHANGED": "CHANGED"}
    assert there == {("a", "REMOVED"), ("b", "CHANGED"), ("c", "ADDED")} and back == {(p, flip[c]) for p, c in there}

"""Requirements, methods and the evidence around them, on small written tables."""

from pyspark.sql import functions as F

from tracequarry.operators import graph
from tracequarry.operators import requirements as rq

METHODS = [
    ("Order.save", "OrderService", "save", "repository.put(order); // ABC-7"),
    ("Order.getCountryCode", "Order", "getCountryCode", "return countryCode;"),
    ("Order.validateOrder", "OrderCheck", "validateOrder", "if (order.getCountryCode() == null) throw e;"),
    ("Order.deleteAll", "OrderService", "deleteAll", ""),
    ("Order.log", "OrderService", "log", None),
    ("None", None, None, None),
]


def candidates(spark, text, ticket="abc-7 "):
    asked = spark.createDataFrame([("r", ticket, text), ("empty", None, None)], "requirement string, ticket string, text string")
    methods = spark.createDataFrame(METHODS, "method string, owner string, name string, body string")
    attributes = spark.createDataFrame([("r", "country_code"), ("r", "countryCode"), ("r", "id"), (None, None)], "requirement string, attribute string")
    return rq.method_candidates(asked, methods, attributes), methods


def test_method_candidates(spark):
    out, methods = candidates(spark, "Reject an order of an invalid country; persist the others")
    got = {r["method"]: (r["n_terms"], r["n_behaviours"], r["n_attributes"], r["score"], r["classification"], r["seed"]) for r in out.collect()}
    assert got == {
        "Order.save": (1, 1, 0, 0.75, "REFERENCED", True),  # 0.22 + 0.18 + 0.35
        "Order.validateOrder": (1, 1, 1, 1.5, "CANDIDATE", True),  # 0.22 + 0.18 + 1.1; the accessor, the removal and the bare owner's term are out
    }
    calls = spark.createDataFrame([("Order.save", "Order.log"), ("Order.log", "Order.getCountryCode"), ("Order.log", "Order.deleteAll"), ("Order.save", "Order.save"), ("Order.save", "unknown"), (None, "Order.log")], "method string, callee string")
    told = {r["method"]: (r["score"], r["call_depth"], r["n_calls"]) for r in rq.called_candidates(out, calls, methods).collect()}
    assert told == {"Order.save": (0.87, 0, 1), "Order.validateOrder": (1.5, 0, 0), "Order.log": (0.59, 1, 2), "Order.deleteAll": (0.175, 2, 0)}


def test_method_candidates_of_nothing(spark):
    out, methods = candidates(spark, None, None)
    assert {r["method"] for r in out.collect()} == {"Order.validateOrder"}  # by its attribute alone
    assert rq.method_candidates(spark.createDataFrame([], "requirement string, ticket string, text string"), methods, spark.createDataFrame([], "requirement string, attribute string")).count() == 0


def test_intents(spark):
    texts = spark.createDataFrame([(1, "Add a field, or save it"), (2, None), (3, "")], "k int, text string")
    words = spark.createDataFrame([("ADD", "add"), ("ADD", "Add"), ("PERSIST", "save"), (None, None)], "intent string, word string")
    assert {r["k"]: r["intents"] for r in rq.intents(texts, words, "k").collect()} == {1: ["ADD", "PERSIST"], 2: ["CHANGE"], 3: ["CHANGE"]}


def test_operation_score(spark):
    rows = [("GET", ["READ"], "x", 6), ("GET", ["ADD"], "x", -2), ("POST", ["PERSIST"], "x", 6), ("PUT", ["ADD"], "x", 3), ("PATCH", ["READ"], "patchRow", 1), ("PUT", ["READ"], None, -1), ("DELETE", ["READ"], "x", -10), (None, ["READ"], "x", 0), ("HEAD", [], "x", 0)]
    df = spark.createDataFrame(rows, "verb string, intents array<string>, name string, want int")
    assert df.where(~rq.operation_score(F.col("verb"), F.col("intents"), F.col("name")).eqNullSafe(F.col("want"))).collect() == []


def test_conditions_pair_by_place(spark):
    schema = "file string, line int, lhs string, operator string, number double"
    old = spark.createDataFrame([("A", 1, "age", ">", 18.0), ("A", 5, "Age", ">", 60.0), ("B", 1, "age", ">", 1.0), ("A", 9, None, ">", 1.0)], schema)
    new = spark.createDataFrame([("A", 1, "AGE", ">=", 18.0), ("A", 6, "age", ">", 60.0), ("C", 1, "age", ">", 1.0)], schema)
    assert [tuple(r) for r in rq.paired_conditions(old, new).collect()] == [("A", "age", 1, ">", 18.0, 1, ">=", 18.0)]


def test_constants_and_branches(spark):
    lines = spark.createDataFrame([("src/A.java", "CODE.matcher(row.getCountry()).matches()"), ("src/test/A.java", "CODE.matcher(row.getCity())"), ("src/B.java", "CODE, getTown()"), ("src/A.java", None)], "path string, text string")
    changed = spark.createDataFrame([("src/A.java", "CODE"), ("src/test/A.java", "CODE"), ("src/A.java", "CODE")], "path string, constant string")
    assert [tuple(r) for r in rq.constant_attributes(changed, lines).collect()] == [("country", "CODE")]
    branches = spark.createDataFrame([("A", "m", "IF", "c", ["country_code", "x"]), ("A", "m", "IF", "c", ["countryCode"]), ("B", "m", "IF", "c", None)], "class_name string, method string, type string, condition string, attributes array<string>")
    assert [tuple(r) for r in rq.branch_evidence(branches, spark.createDataFrame([("countryCode",), ("",), (None,)], "attribute string")).collect()] == [("countryCode", "A", "m", "IF", "c")]


def test_buckets_and_counts(spark):
    rows = spark.createDataFrame([("q", "mapping", 2), ("q", "mapping", 1), ("q", "mapping", 1), ("q", None, 5), ("q", "test", None)], "k string, kind string, item int")
    assert sorted(tuple(r) for r in rq.bucketed(rows, "k", "kind", {"mapping": "mappings"}, "item", first=1).collect()) == [("q", "mappings", 2, [1]), ("q", "other", 1, [5])]
    files = spark.createDataFrame([("p", "A.x", None), ("p", None, "a.X"), ("p", None, None), (None, "b", "c")], "scope string, ref string, name string")
    assert {tuple(r) for r in rq.counts_by_scope(files, "scope", "ref", "name").collect()} == {("p", 1, 3), (None, 1, 1)}


def test_dependency_paths(spark):
    tree = [("r", None, 0, "A.a", True), ("x", "r", 1, "B.b", True), ("y", "x", 0, "C.c", True), ("z", "r", 0, "B.b", True), ("w", "z", 0, "A.a", True), ("u", "r", 2, "D.d", False), ("v", "u", 0, "C.c", True), ("q", None, 0, None, True)]
    calls = spark.createDataFrame(tree, "id string, parent string, pos int, symbol string, verified boolean")
    changes = spark.createDataFrame([("C.c",), ("B.b",), ("B.b",), (None,)], "symbol string")
    got = {(r["flow"], ">".join(r["path"]), r["rank"]) for r in graph.dependency_paths(calls, changes).collect()}
    assert got == {("r", "A.a>B.b", 1), ("r", "A.a>B.b>C.c", 2)}  # both B.b are one way; A.a does not come twice, D.d is not verified
    assert [r["rank"] for r in graph.dependency_paths(calls, changes, first=1).collect()] == [1]
    assert graph.dependency_paths(calls.limit(0), changes).count() == 0


def test_focused(spark):
    nodes = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "r"), ("d", None)], "id string, project string")
    edges = spark.createDataFrame([("a", "b", "READS"), ("a", "b", "READS"), ("b", "c", "READS"), ("a", "d", "CALLS"), ("p", "q", "DEPENDS_ON"), ("q", "r", "DEPENDS_ON")], "source string, target string, type string")
    got = {tuple(r) for r in graph.focused(nodes, edges, spark.createDataFrame([("a",), ("a",), (None,)], "id string"), ["READS"]).collect()}
    assert got == {("a", "b", "READS"), ("p", "q", "DEPENDS_ON")}


def test_evidence_edges(spark):
    rows = spark.createDataFrame([(1, "t", "e"), (1, "t", "e"), (None, "t", "e")], "source int, target string, evidence string")
    got = sorted((r["type"], r["classification"]) for r in graph.evidence_edges(rows, rows, rows, rows.limit(0)).collect())
    assert got == [("COVERS_JIRA", "VERIFIED"), ("POSSIBLY_COVERS_JIRA", "INFERRED"), ("REFERENCES_JIRA", "VERIFIED")]

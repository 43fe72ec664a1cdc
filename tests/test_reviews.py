"""Review operators on written tables."""

import json

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import reviews as rv


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scenario_candidates(spark):
    scenarios = frame(spark, "scenario int, verb string, path string, classes array<string>", (1, "get", "/api/a/{id}", None), (2, "GET", "/x/b", ["p.Owner"]), (3, "POST", "/a/{k}", ["None"]), (4, "GET", None, ["OWNER", None]), (5, "GET", "/c", []))
    entries = frame(spark, "verb string, path string, method string", ("GET", "/a/{x}", "m1"), ("GET", "/b", "m2"), ("GET", "/v2/x/b", "m3"), ("GET", "/", "m1"), (None, "/c", "m1"), ("GET", None, "m1"))
    calls = frame(spark, "source string, target string", ("m1", "k"), ("k", "deep"), ("deep", "k"), ("m2", "deep"), (None, "deep"))
    candidates = frame(spark, "method string, owner string", ("deep", "Owner"), ("k", None), ("deep", "Owner"))
    # 1 meets /a/{} as the only end; 2 has two ends, so only its class counts
    want = [(1, "ENDPOINT_CALL_PATH", 2, 0), (2, "DECLARED_CLASS_OVERLAP", 0, 1), (4, "DECLARED_CLASS_OVERLAP", 0, 1)]
    assert got(rv.scenario_candidates(scenarios, entries, calls, candidates)) == want
    assert got(rv.scenario_candidates(scenarios.limit(0), entries, calls, candidates)) == []
    assert got(rv.scenario_candidates(scenarios, entries, calls.limit(0), candidates.limit(0))) == []


def test_route_conflict(spark):
    rows = frame(spark, "i int, e string, a string", (1, "PATCH /s/{id}/email", "country"), (2, "patch /s/Email/?q=1", "email"), (3, "PUT /s/email", "country"), (4, "PATCH /s/{id}", "email"), (5, None, "email"), (6, "PATCH /s/email", None), (7, "PATCH /s/other", "email"))
    out = rows.select("i", rv.route_conflict(F.col("e"), F.col("a"), {"email": {"email", "primary-email"}, "country": {"country"}}))
    assert got(out) == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (7, False)]


def test_pair_review(spark):
    pairs = frame(spark, "pair int, n_matches int, endpoint_changed boolean, db_changed boolean, members_changed boolean, complete boolean", (1, 1, True, True, True, True), (2, 0, False, False, False, True), (3, None, None, None, None, None), (4, 0, True, False, False, True))
    tests = frame(spark, "pair int, status string", (1, "fail"), (2, "pass"), (2, "PASS"), (4, None), (9, "FAIL"))
    out = {r.pair: (r.points, r.level, r.reasons) for r in rv.pair_review(pairs, tests).collect()}
    assert out[1][:2] == (100, "HIGH") and out[2] == (0, "LOW", []) and out[3] == (20, "UNKNOWN", ["NO_RESULTS"]) and out[4] == (45, "MEDIUM", ["ENDPOINT", "NO_RESULTS"])


def test_what_if(spark):
    asked = frame(spark, "requirement int, text string", (1, "Add fullName from firstName and LASTNAME."), (2, "xfirstName éfirstName"), (3, None), (1, "Add fullName"))
    evidence = frame(spark, "field string, file string", ("firstName", "a"), ("firstname", "b"), ("firstName", "a"), ("lastName", None), (None, "c"))
    want = [(1, "firstname", "EXISTING_FIELD_IMPACT", 2), (1, "fullname", "PROPOSED_DERIVED_ATTRIBUTE", 0)]
    assert got(rv.what_if(asked, evidence, {"fullName": ["firstName", "lastName"]})) == want
    assert got(rv.what_if(asked, evidence.limit(0), {"fullName": ["firstName"]})) == []


def test_what_if_keeps_other_words_where_they_are(spark):
    """Before, every word of every requirement was exchanged."""
    asked = frame(spark, "requirement int, text string", (1, "one field and many words"), (1, "field again"), (2, "words"))
    out = rv.what_if(asked, frame(spark, "field string, file string", ("Field", "f")), {"many": ["Field"]})
    assert got(out) == [(1, "field", "EXISTING_FIELD_IMPACT", 1), (1, "many", "PROPOSED_DERIVED_ATTRIBUTE", 0)]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_file_scores(spark):
    asked = frame(spark, "requirement int, text string", (1, "validate customer email"), (2, None))
    concepts = frame(spark, "requirement int, concept string", (1, "Customer-Mapper"))
    files = frame(spark, "path string, class_name string, methods array<string>, content string", ("a", "CustomerMapper", ["validateEmail", "mapEmail", "emailOf", None], "email validate"), ("b", None, None, None), ("c", "Other", [], "nothing"))
    hits = frame(spark, "requirement int, path string", (1, "c"), (1, "c"), (1, "a"))
    # words: validate customer email mapper; class 6 + 2, source 2, methods 4, one hit 4, concept 4
    assert got(rv.file_scores(asked, concepts, files, hits)) == [(1, "a", 2, 2, 3, 1, True, 22), (1, "c", 0, 0, 0, 2, False, 5)]


def test_evaluation(spark):
    tests = frame(spark, "scenario int, test string, tickets array<string>", (2, "Login ", ["a-1", "A-1 ", None, ""]), (1, "LOGIN", ["a-1"]), (3, None, ["b-2"]), (4, " ", ["b-2"]))
    cases = rv.evaluation_cases(tests, "Which ticket for %s?", ["q", "q"])
    assert got(cases) == [("NEGATIVE", "q", None, None, None), ("POSITIVE", "Which ticket for LOGIN?", "A-1", "LOGIN", 1)]
    judged = frame(spark, "case int, case_type string, g int", (1, "POSITIVE", 0), (2, "POSITIVE", 0), (3, "NEGATIVE", 0), (4, "NEGATIVE", 1))
    results = frame(spark, "case int, rank int, relevant boolean", (1, 1, False), (1, 3, True), (1, 2, None), (2, 9, True), (4, 1, False))
    assert got(rv.evaluation_summary(judged, results, ["g"])) == [(0, 3, 2, 0.4444, 0.5, 0.1667, 2), (1, 1, 0, 0.0, 0.0, 0.0, 1)]


def test_reconciled(spark):
    names = "document int, project string, filename string, family string, version string, status string, source_ref string, checksum string, n_rows int"
    docs = frame(spark, names, (1, "c:/p/", "Map_v2.xlsx", "MAP", "V1", "ACTIVE", None, "x", 5), (2, "C:\\P", "Map_v2.xlsx", "MAP", "V2", "ACTIVE", "", "x", 0), (3, "C:\\p", "Other.xlsx", None, "V9", "ACTIVE", "r", None, None), (4, "D:\\p", "Other.xlsx", None, None, "ACTIVE", "r", None, 1), (5, "C:\\p", None, None, None, None, None, None, None))
    want = [(1, "MAP", "V2", "ACTIVE", True, True), (2, "MAP", "V2", "DUPLICATE", False, True), (3, "OTHER", "V9", "ACTIVE", True, False), (5, None, None, None, True, False)]
    assert got(rv.reconciled(docs, "C:/p/").drop("project")) == want


def test_flow_methods(spark):
    def node(c, m, *calls):
        return {"class_name": c, "method_name": m, "calls": list(calls)}

    tree = node("A", "a", node("B", "b", node("A", "a"), node("C", "c")), *[node("D", f"d{i}") for i in range(12)], node("B", "b"), node(None, "x", node("E", 'e"q')), "text")
    flows = frame(spark, "k int, t string", (1, json.dumps(tree)), (2, json.dumps({"flow": tree, "other": node("X", "x")})), (3, "{}"), (4, None), (5, "no json"))
    want = ["A.a", "B.b", "C.c", *[f"D.d{i}" for i in range(12)], 'E.e"q']
    assert got(rv.flow_methods(flows, "k", "t")) == [(1, want), (2, want)]


def test_flow_methods_where_trees_lie(spark):
    """Before, every tree was exploded level by level and its names met in three exchanges."""
    leaf = '{"class_name":"B","method_name":"b"}'
    tree = '{"flow":{"class_name":"A","method_name":"a","calls":[%s]},"class_name":"C"}' % leaf
    flows = frame(spark, "k int, t string", (1, tree), (2, '{"class_name":"A","class_name":"B","method_name":"b"}'), (3, '[' + leaf + ']'), (4, '{"class_name":7,"method_name":"m","calls":{"0":1}}'), (5, '{"class_name":"","method_name":"m","calls":[null,%s]}' % leaf))
    out = rv.flow_methods(flows, "k", "t")
    assert got(out) == [(1, ["C.a", "B.b"]), (5, ["B.b"])]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert got(rv.flow_methods(flows, "k", "t", 3)) == [(1, ["C.a"]), (5, ["B.b"])]


def test_roles_and_scope(spark):
    rows = frame(spark, "v string, t boolean", ("patch", True), ("PATCH", None), ("GET", True), ("DELETE", True), (None, None), ("post", False))
    role = rv.operation_role(F.col("v"), F.col("t"))
    scope = rv.change_scope(F.col("v"), F.col("t"), F.lit(1), F.lit(0), F.lit(False))
    out = {r[0]: tuple(r[1:]) for r in rows.select("v", role["priority"], scope).collect()}
    assert out == {"patch": ("HIGH", "PROPOSED_IMPLEMENTATION"), "PATCH": ("LOW", "INDIRECT_REGRESSION"), "GET": ("MEDIUM", "REGRESSION_ONLY_OR_UNRELATED"), "DELETE": ("LOW", "REGRESSION_ONLY_OR_UNRELATED"), None: ("REVIEW", "REVIEW_ONLY"), "post": ("HIGH", "PROPOSED_IMPLEMENTATION")}


def test_refreshed(spark):
    paths = frame(spark, "path string", ("a",), ("b",))
    declared = frame(spark, "path string, field string", ("a", "x"), ("a", "y"), ("b", "z"), ("a", None))
    lines = frame(spark, "field string, path string, line int", ("x", "b", 1), ("x", "b", 1), ("x", "a", 2), ("z", "a", 3))
    assert got(rv.refreshed(paths.where("path = 'a'"), declared, lines, paths, paths)) == [("x", 2, 2), ("y", 0, 0)]
    with pytest.raises(ValueError, match="b was not read"):
        rv.refreshed(paths, declared, lines, paths, paths.where("path = 'a'"))


def test_symbol_lookup(spark):
    symbols = frame(spark, "path string, class_name string, method string, line int, content string", ("p", "UserService", "save", 3, "c"), ("p", "UserService", "load", 9, "c"), ("q", "UserMapper", None, None, None), ("q", "UserMapper", None, None, None))
    asked = frame(spark, "request int, text string", (1, "see UserService.save(x)"), (2, "UserService please"), (3, "UserMapper"), (4, "nothing"), (5, None), (6, "UserService.gone()"))
    out = [r[:5] for r in got(rv.symbol_lookup(asked, symbols, ("Service", "Mapper")))]
    assert out == [(1, "UserService", "save", "p", 3), (2, "UserService", None, "p", None), (3, "UserMapper", None, "q", None)]


def test_orders_and_attribute_impact(spark):
    hits = frame(spark, "change int, ticket string, n_matches int", (1, "b", 2), (1, "a", 2), (1, "c", 3), (2, "a", 1))
    assert got(rv.by_relevance(hits)) == [(1, "a", 2, 2), (1, "b", 2, 3), (1, "c", 3, 1), (2, "a", 1, 1)]
    uses = frame(spark, "change int, symbol string, scenario int, endpoint int", (1, "s", 1, 1), (1, "s", 1, 2), (1, "r", 1, 1), (1, "t", 1, 1), (1, "t", 2, None))
    assert got(rv.by_reach(uses)) == [(1, "r", 1, 1, 3), (1, "s", 1, 2, 2), (1, "t", 2, 1, 1)]
    evidence = {"tickets": frame(spark, "attribute string, item int", ("first_name", 1), ("FirstName", 1), ("firstName", None)), "mappings": frame(spark, "attribute string, item string", ("other", "m"), (None, "n"))}
    asked = frame(spark, "attribute string", ("firstName",), ("first-name",), ("zip",), (None,), ("",))
    assert got(rv.attribute_impact(asked, evidence)) == [("first-name", 1, 0, "EVIDENCE_FOUND"), ("zip", 0, 0, "NO_EVIDENCE")]

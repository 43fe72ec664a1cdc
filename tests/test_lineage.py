"""Roles of classes, contracts of mappings, impact of changed mappings and divergence on small written tables."""

import re

import pytest

from tracequarry.operators import lineage


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_roles_pass_along_fields_in_cycles_and_keep_their_seed(spark):
    classes = spark.createDataFrame(
        [("Api", ["RestController"], []), ("In", [], []), ("Out", None, None), ("Deep", [], []), ("Both", ["Entity"], []), ("Repo", [], ["X", "CrudRepository"]), ("Map", ["Mapper", "Component"], []), ("Comp", ["Component"], []), ("Alone", ["Other"], []), (None, ["Entity"], [])],
        "class_name string, annotations array<string>, bases array<string>",
    )
    signatures = spark.createDataFrame([("Api", ["In", "Unknown"], ["List", "Out"]), ("Comp", ["Alone"], ["Alone"]), ("Api", None, ["Out", None])], "class_name string, body_types array<string>, return_types array<string>")
    fields = spark.createDataFrame([("In", "Deep"), ("Deep", "In"), ("Deep", "Both"), ("Out", "Both"), ("Both", "Unknown"), ("Out", "Out"), (None, "In"), ("In", None)], "class_name string, type string")
    got = rows(lineage.class_roles(classes, signatures, fields))
    assert got == sorted([
        ("Api", "CONTROLLER", "Api", 0), ("In", "REQUEST_MODEL", "In", 0), ("Out", "RESPONSE_MODEL", "Out", 0), ("Deep", "REQUEST_MODEL", "In", 1), ("Both", "ENTITY", "Both", 0), ("Both", "REQUEST_MODEL", "In", 2),
        ("Both", "RESPONSE_MODEL", "Out", 1), ("Repo", "REPOSITORY", "Repo", 0), ("Map", "MAPPER", "Map", 0), ("Comp", "COMPONENT", "Comp", 0), ("Alone", "JAVA_CLASS", "Alone", 0),
    ], key=str)
    assert rows(lineage.class_roles(classes.limit(0), signatures, fields)) == []


def test_the_nearest_seed_wins_and_of_equals_the_least(spark):
    labels = spark.createDataFrame([("b", "X"), ("a", "X"), ("far", "X"), ("a", "Y"), (None, "X")], "node string, label string")
    edges = spark.createDataFrame([("far", "m"), ("m", "t"), ("a", "t"), ("b", "t"), ("t", "a"), ("t", None)], "source string, target string")
    got = {(n, l): (s, d) for n, l, s, d in rows(lineage.propagated(labels, edges))}
    assert got[("t", "X")] == ("a", 1) and got[("t", "Y")] == ("a", 1) and got[("m", "X")] == ("far", 1) and got[("a", "X")] == ("a", 0) and ("m", "Y") not in got


CALLS = "caller string, receiver_type string, name string, file string, line int"


def test_a_step_needs_the_declared_type_of_its_receiver(spark):
    checks = spark.createDataFrame([("type", "Svc.updateType")], "attribute string, method string")
    calls = spark.createDataFrame(
        [("Ctl.a", "Other", "updateType", "f", 1), ("Ctl.b", None, "updateType", "f", 2), ("Ctl.c", "Svc", "updateType", "f", 4), ("Ctl.c", "Svc", "updateType", "f", 3), ("Svc.own", "Svc", "updateType", "f", 5), ("Top.x", "Ctl", "c", "g", 9), ("Ctl.c", "Top", "x", "f", 6), ("Top.updateName", "Ctl", "c", "g", 10), ("Svc.updateType", "Ctl", "c", "s", 1)],
        CALLS,
    )
    endpoints = spark.createDataFrame([("Top.x", "GET", "/x"), ("Top.updateName", "PUT", "/n"), ("Svc.updateType", "PUT", "/t"), ("Ctl.a", "GET", None)], "method string, http_method string, endpoint string")
    observed = spark.createDataFrame([("type", "Ctl.c", "f", 3), ("type", "Ctl.c", "f", 3), ("type", "Ctl.c", "f", 4)], "attribute string, method string, file string, line int")
    got = rows(lineage.contract_paths(checks, calls, endpoints, observed))
    # the place is that of the call of the checked method; a way through updateName is about another field; the chain never turns back
    assert got == [("type", ["Top.x", "Ctl.c", "Svc.updateType"], "GET", "/x", "f", 3)]
    none = endpoints.limit(0)
    lone = rows(lineage.contract_paths(checks, calls, none, observed))
    assert lone == [("type", ["Ctl.c", "Svc.updateType"], None, None, "f", 3)]
    assert rows(lineage.contract_paths(checks, calls, none, observed.limit(0))) == [] and rows(lineage.contract_paths(checks.limit(0), calls, endpoints, observed)) == []

    scenarios = spark.createDataFrame([("S1", "get", "X/"), ("S2", "post", "/x"), ("S3", None, None)], "scenario string, http_method string, endpoint string")
    edges = rows(lineage.contract_edges(observed, lineage.contract_paths(checks, calls, endpoints, observed), scenarios))
    assert edges == sorted([
        ("attribute:type", "method:Ctl.c", "SOURCE_REFERENCE_ONLY", "f", 3), ("attribute:type", "method:Ctl.c", "SOURCE_REFERENCE_ONLY", "f", 4), ("method:Top.x", "method:Ctl.c", "LEXICAL_NOT_TYPE_RESOLVED", None, None),
        ("method:Ctl.c", "method:Svc.updateType", "LEXICAL_NOT_TYPE_RESOLVED", None, None), ("api:GET /x", "method:Top.x", "ENDPOINT_SOURCE_CANDIDATE", None, None), ("api:GET /x", "scenario:S1", "ENDPOINT_MATCH_ONLY", None, None),
    ], key=str)


def test_what_trims(spark):
    mappings = spark.createDataFrame([("Obj.Name", "must TRIM", None), ("code", None, "trimmed"), ("x.y", None, "trim"), (None, "trim", None)], "target string, mapping_rule string, validation_rule string")
    setters = spark.createDataFrame(
        [("C", "m", "name", e, "f", i) for i, e in enumerate(["a.get().trim ()", "clean(a)", "this.twice(a)", "clean(a) + b", "a", None])] + [("D", "m", "name", "clean(a)", "f", 9), ("C", "m", "code", "a", "f", 1)],
        "class_name string, method string, attribute string, expression string, file string, line int",
    )
    methods = spark.createDataFrame([("C", "clean", True), ("C", "twice", True), ("C", "twice", True), ("D", "other", True)], "class_name string, method string, trims boolean")
    got = {(r.method, r.expression): r.status for r in lineage.contract_checks(mappings, setters, methods).collect()}
    bad = "POTENTIAL_MISMATCH_NO_LOCAL_TRIM"
    assert got == {("C.m", "a.get().trim ()"): "LOCAL_TRIM_PRESENT", ("C.m", "clean(a)"): "HELPER_TRIM_PRESENT_CANDIDATE", ("C.m", "this.twice(a)"): bad, ("C.m", "clean(a) + b"): bad, ("C.m", "a"): bad, ("C.m", None): bad, ("D.m", "clean(a)"): bad}


def test_renames_need_exactly_one_of_each(spark):
    shape = "family string, attribute string, target string, rule string"
    old = spark.createDataFrame([("f", "a", "O.x", "r"), ("f", "b", "O.p", "r"), ("f", "b", "O.q", "r"), ("f", "c", "O.same", "r"), ("f", "d", "o.RULE", "r"), ("f", "n", None, "r"), ("g", "a", "O.z", "r")], shape)
    new = spark.createDataFrame([("f", "A", "O.y", "r"), ("f", "b", "O.s", "r"), ("f", "c", "O.SAME", "r"), ("f", "d", "O.rule", "t"), ("f", "d", "O.rule", "s"), ("h", "a", "O.w", None)], shape)
    changes = lineage.mapping_changes(old, new)
    assert rows(changes) == sorted([
        ("f", "A", "RENAMED", "O.x", "O.y"), ("f", "b", "REMOVED", "O.p", None), ("f", "b", "REMOVED", "O.q", None), ("f", "b", "ADDED", None, "O.s"), ("f", "c", "UNCHANGED", "O.same", "O.SAME"),
        ("f", "d", "CHANGED", "o.RULE", "O.rule"), ("g", "a", "REMOVED", "O.z", None), ("h", "a", "ADDED", None, "O.w"),
    ], key=str)
    nodes = spark.createDataFrame([("n1", "x"), ("n2", "Y"), ("n3", "x")], "id string, name string")
    edges = spark.createDataFrame([("m", "n1", "READS"), ("m", "n3", "READS"), ("k", "m", "CALLS"), ("m", "dom", "OWNS"), ("k", "n2", "READS")], "source string, target string, type string")
    got = rows(lineage.mapping_change_impact(changes, nodes, edges, ["READS", "CALLS"], ["OWNS"]))
    assert got == sorted([
        ("f", "RENAME", "O.x", "O.y", None), ("f", "CALLERS", "O.x", "m", 1), ("f", "CALLERS", "O.x", "k", 2), ("f", "BUSINESS", "O.x", "dom", 2), ("f", "CALLERS", "O.y", "k", 1),
        ("f", "TARGET_NOT_FOUND_IN_CODE", "O.s", "HIGH", None), ("f", "TARGET_NOT_FOUND_IN_CODE", "O.rule", "HIGH", None), ("h", "TARGET_NOT_FOUND_IN_CODE", "O.w", "HIGH", None), ("f", "REMOVED_MAPPING", None, "MEDIUM", 2), ("g", "REMOVED_MAPPING", None, "MEDIUM", 1),
    ], key=str)
    assert rows(lineage.mapping_change_impact(changes.limit(0), nodes, edges, ["READS"], ["OWNS"])) == []

"""Grounding, registry documents, evidence search, rich text and divergence on small written tables."""

import json
import random

from tracequarry.operators import knowledge, lineage


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_grounded_needs_every_kind(spark):
    queries = spark.createDataFrame(
        [
            (1, ["which", "release", "tested", "student", "promotion"], ["release", "student", "promotion"], None),
            (2, ["what", "is", "promotion"], ["promotion"], None),
            (3, ["where", "was", "promotion", "changed"], ["promotion", "changed"], []),
            (4, ["show", "covered", "jiras"], ["covered", "jiras"], None),
            (5, ["promotion"], ["promotion"], ["history"]),
            (6, None, None, None),
        ],
        "query_id int, tokens array<string>, subjects array<string>, intents array<string>",
    )
    documents = spark.createDataFrame(
        [("a", ["student", "promotion"], "R1", 2), ("b", ["employee", "promotion"], "R1", 2), ("c", ["student", "grant"], "R1", 1), ("d", ["student", "promotion"], " Unknown Release ", 3), ("e", ["student", "promotion"], "R2", 0), ("f", None, None, None)],
        "doc_id string, tokens array<string>, release string, n_tests int",
    )
    ranked = spark.createDataFrame([(q, d, i) for q in range(1, 7) for i, d in enumerate("abcdef")], "query_id int, doc_id string, rank int")
    required = knowledge.constraints(queries)
    got = {}
    for q, d, _ in rows(knowledge.grounded(ranked, required, documents)):
        got.setdefault(q, []).append(d)
    assert got == {1: ["a"], 2: list("abcdef"), 3: list("abde"), 4: list("abcdef"), 5: list("abde"), 6: list("abcdef")}
    assert knowledge.grounded(ranked.limit(0), required, documents).count() == 0


def test_registry_documents(spark):
    scenarios = spark.createDataFrame([(1, "OP1", "Name", None, "GET", "/x", " tk-9 "), (2, "OP2", None, "d", None, None, None)], "scenario_id int, code string, name string, description string, http_method string, endpoint string, ticket string")
    baselines = spark.createDataFrame([(10, 1, "Sept", 7, 3), (11, 1, None, None, 4), (12, 9, "x", 1, 1)], "baseline_id int, scenario_id int, name string, release_version int, version int")
    tests = spark.createDataFrame(
        [(1, 1, 10, 3, "both ways", "PASS", ["tk-1", "TK-1", "TK-2", ""]), (2, 1, 10, 4, "two releases", None, None), (3, 1, 99, 3, "orphan with a version", "FAIL", []), (4, 1, None, 8, "nowhere", None, ["TK-3"]), (5, 2, 10, 3, "of another scenario", None, ["TK-2"])],
        "test_id int, scenario_id int, baseline_id int, code_version int, name string, status string, tickets array<string>",
    )
    tickets = spark.createDataFrame([("TK-1", "First", None), ("tk-2", None, "must"), ("TK-7", "x", "y")], "ticket string, title string, requirement string")
    got = {r.document_id: r for r in knowledge.registry_documents(scenarios, baselines, tests, tickets).collect()}
    assert sorted(got) == sorted([
        "scenario:1", "scenario:2", "scenario:1:release:10", "scenario:1:release:11", "scenario:1:test:1:release:10", "scenario:1:test:2:release:10", "scenario:1:test:2:release:11", "scenario:1:test:3:release:10", "scenario:1:test:3:release:orphan", "scenario:2:test:5:release:orphan",
    ])
    release = got["scenario:1:release:10"]
    assert (release.n_tests, release.tickets, release.title) == (3, ["TK-1", "TK-2"], "OP1 · Sept V7")
    assert release.text == "Release baseline for OP1\nEndpoint GET /x\nRelease Sept V7\nCode baseline V3\nTest baselines both ways, two releases, orphan with a version\nJIRAs TK-1, TK-2"
    assert got["scenario:1:release:11"].title == "OP1 · Release V4"
    assert got["scenario:1:test:1:release:10"].text == "Test baseline both ways\nParent scenario OP1\nEndpoint GET /x\nRelease Sept V7\nStatus PASS\nJIRA TK-1\nJIRA title First\nJIRA TK-2\nJIRA requirement must"
    assert got["scenario:1:test:3:release:orphan"].title == "orphan with a version · Unknown Release V3"
    assert got["scenario:1"].tickets == ["TK-9"] and got["scenario:2"].tickets == [] and got["scenario:2"].text == "Operation scenario OP2\nd"
    assert knowledge.registry_documents(scenarios.limit(0), baselines, tests, tickets).count() == 0


def test_evidence_search_has_both_modes(spark):
    queries = spark.createDataFrame(
        [(1, "p", ["TK-1"], []), (2, "p", [], ["Alpha"]), (3, "p", [], ["nothing"]), (4, "p", ["TK-404"], None), (5, "q", ["TK-1", "TK-2"], None), (6, None, None, None)],
        "query_id int, project string, tickets array<string>, entities array<string>",
    )
    tickets = spark.createDataFrame([("tk-1", "p", ["beta"]), ("TK-2", None, []), ("TK-3", "p", ["alpha"])], "ticket string, project string, entities array<string>")
    documents = spark.createDataFrame(
        [(1, "p", "TEST", ["BETA", "gamma"]), (2, "p", "API", ["gamma"]), (3, "q", "API", ["beta", "gamma"]), (4, "p", "Notes", ["alpha"]), (5, "p", "JIRA", ["delta"]), (6, "p", "RELEASE", ["epsilon"]), (7, "p", None, None), (8, "p", "TEST", ["delta"])],
        "doc_id int, project string, source_type string, entities array<string>",
    )
    matches = spark.createDataFrame([(1, 6), (3, 5), (3, 3), (3, 7), (4, 6), (6, 1)], "query_id int, doc_id int")
    links = spark.createDataFrame([("Gamma", "epsilon"), (None, "x")], "entity string, other string")
    got = rows(knowledge.evidence_search(queries, tickets, documents, matches))
    exact, semantic = "EXACT_ENTITY", "SEMANTIC"
    want = [
        (1, exact, "requirements", "TICKET", "tk-1"), (1, exact, "tests", "DOCUMENT", "1"), (1, exact, "api_docs", "DOCUMENT", "2"), (2, exact, "notes", "DOCUMENT", "4"),
        (3, semantic, "requirements", "DOCUMENT", "5"), (3, semantic, "tests", "DOCUMENT", "8"), (3, semantic, None, "DOCUMENT", "7"), (4, semantic, "releases", "DOCUMENT", "6"), (5, exact, "requirements", "TICKET", "TK-2"),
    ]
    assert got == sorted(want, key=str)
    more = rows(knowledge.evidence_search(queries, tickets, documents, matches, links))
    assert set(more) - set(got) == {(1, exact, "releases", "DOCUMENT", "6")} and set(got) <= set(more)


def plainly(v):
    """As the rule says it, by recursion."""
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return "\n".join(plainly(x) for x in v)
    if isinstance(v, dict):
        parts = (str(v.get("text") or ""), plainly(v.get("content") or []))
        return " ".join(x for x in parts if x).strip()
    return str(v)


def test_tree_text(spark):
    rng = random.Random(7)

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice([None, "", " a b ", 'q"\\\n{[,:]}é ', 0, 1.5, True, False, "x"])
        if kind < 0.6:
            return [tree(depth - 1) for _ in range(rng.randrange(4))]
        node = {"type": "p", "attrs": {"text": "no", "k": [1, {}]}}
        if rng.random() < 0.6:
            node["text"] = rng.choice(["hi", " ", "", None, "tail "])
        if rng.random() < 0.8:
            node["content"] = tree(depth - 1)
        return node

    trees = [tree(5) for _ in range(300)]
    for t in trees:
        for told in (json.dumps(t), json.dumps(t, ensure_ascii=False, indent=2)):
            assert knowledge.tree_text(told) == plainly(t), told
    deep = '{"content":[' * 20000 + '"end"' + "]}" * 20000
    assert knowledge.tree_text(deep) == "end"
    for bad in ("", "{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "]", '{1:2}', '"a" "b"', "{]", '{"a":}', "nul", '"x'):
        assert knowledge.tree_text(bad) is None, bad
    df = spark.createDataFrame([(1, "old", '[["a"],null]'), (2, "old", None), (3, None, "{")], "id int, text string, tree string")
    assert [tuple(r) for r in knowledge.rich_text(df).orderBy("id").collect()] == [(1, '[["a"],null]', "a\n"), (2, None, None), (3, "{", None)]


EVENTS = "defect int, attribute string, class_name string, method string, line int, step int, code string, usage_type string, direct boolean"


def test_what_a_line_does(spark):
    cases = [
        ("a.setEmail(b.getEmail());", None, "MAPPING"), ("a.setemail(b.email().toUpperCase());", None, "VALUE_TRANSFORMED"), ("a.setEmail(x + y);", None, "VALUE_TRANSFORMED"), ("a.setEmail(NULL);", None, "NULL_OVERWRITE"),
        ("a.setEmail(b);", "value_transformed", "VALUE_TRANSFORMED"), ("  // a.setEmail(null);", "MAPPING", "COMMENTED_OUT"), ("* email", None, "COMMENTED_OUT"), ("/* email */", None, "COMMENTED_OUT"), ("/* a */ email = b;", None, "ASSIGNMENT"),
        ("email = null;", None, "NULL_OVERWRITE"), ("email = b.trim();", None, "VALUE_TRANSFORMED"), ("if (email == b) {", None, "CONDITIONAL_PATH"), ("if (other) { x(b.getEmail()); }", None, "READ"), ("r = e == null ? null : e.getEmail();", None, "READ"),
        ("r = e.getEmail() ? a : b;", None, "CONDITIONAL_PATH"), ("return ok && email;", None, "CONDITIONAL_PATH"), ("repo.save(e);", None, "PERSISTENCE"), ("x = b.isEmail();", None, "READ"), ("log(email)", "overwrite", "OVERWRITE"), ("log(email)", "odd", "ODD"), ("log(email)", None, "REFERENCE"), (None, None, "REFERENCE"), ("emails = b;", None, "REFERENCE"),
    ]
    df = spark.createDataFrame([(i, "email", c, u, i % 2 == 1) for i, (c, u, _) in enumerate(cases)], "i int, attribute string, code string, usage_type string, direct boolean")
    got = {r.i: (r.usage, r.score) for r in lineage.classified(df).collect()}
    for i, (code, _, usage) in enumerate(cases):
        assert got[i] == (usage, 0 if usage == "COMMENTED_OUT" else lineage.WEIGHTS.get(usage, 10) + 20 * (i % 2)), code


def test_ranking_and_the_likely_place(spark):
    ev = lambda d, line, step, code, usage=None, direct=False, m="m": (d, "sum", "C", m, line, step, code, usage, direct)
    events = spark.createDataFrame(
        [
            ev(1, 5, 2, "x.setSum(r.sum());"), ev(1, 5, 1, "x.setSum(r.sum());", direct=True), ev(1, None, 0, "x.setSum(null);"), ev(1, 9, 3, "x.setSum(null);"),
            ev(2, 4, 0, "// x.setSum(1);"), ev(2, 5, 0, "y(sum)"),
            ev(3, 4, 0, "x.setSum(r.sum());"), ev(3, 8, 1, "x.setSum(5);"), ev(3, 7, 1, "x.setSum('6');"), ev(3, 2, 1, "x.setSum(5);", m="other"),
            ev(4, 4, 0, "x.setSum(r.sum());", m="setSum"), ev(4, 5, 0, "public void setSum(int x) { sum = x; }"),
            ev(5, 3, 0, "x.setSum(r.sum());"),
        ],
        EVENTS,
    )
    whole = lineage.divergence_ranking(events, first=None)
    assert [(r.line, r.step, r.usage, r.score, r.rank) for r in whole.where("defect = 1").orderBy("rank").collect()] == [(9, 3, "NULL_OVERWRITE", 120, 1), (None, 0, "NULL_OVERWRITE", 120, 2), (5, 1, "MAPPING", 90, 3)]
    assert lineage.divergence_ranking(events, first=1).count() == 5
    defects = spark.createDataFrame([(1, "sum", "7", "8", "7"), (2, "sum", "7", None, "7"), (3, "sum", "7", "5", "7"), (4, "sum", "7", None, "7"), (5, "sum", "7", "1", "7"), (6, "sum", None, None, None), (7, "sum", "7", "7", None)], "defect int, attribute string, expected string, actual string, input string")
    got = {r.defect: (r.classification, r.confidence, r.method, r.line) for r in lineage.likely_divergence(whole, defects).collect()}
    assert got == {
        1: ("NULL_OVERWRITE", "HIGH", "m", 9), 2: ("MISSING_MAPPING", "HIGH", "m", 4), 3: ("VALUE_OVERWRITTEN", "HIGH", "m", 8), 4: ("MISSING_MAPPING", "MEDIUM", None, None), 5: ("MAPPING_REVIEW_REQUIRED", "MEDIUM", "m", 3),
        6: ("NO_DETERMINISTIC_DIVERGENCE_FOUND", "LOW", None, None), 7: ("INPUT_MISSING_OR_NULL", "HIGH", None, None),
    }


def test_a_write_without_a_line_comes_after_all_others(spark):
    ev = lambda d, c, line, code: (d, "sum", c, "m", line, 1, code, None, False)
    events = spark.createDataFrame([ev(1, "C", 4, "x.setSum(r.sum());"), ev(1, "C", None, "x.setSum(5);"), ev(2, "C", None, "x.setSum(r.sum());"), ev(2, "C", None, "x.setSum(5);"), ev(3, "C", 4, "x.setSum(r.sum());"), ev(3, "C", 6, "x.setSum(5);"), ev(3, "C", None, "y.setSum(5);")], EVENTS)
    defects = spark.createDataFrame([(i, "sum", "7", "5", "7") for i in (1, 2, 3)], "defect int, attribute string, expected string, actual string, input string")
    got = {r.defect: (r.classification, r.class_name, r.line) for r in lineage.likely_divergence(lineage.divergence_ranking(events, first=None), defects).collect()}
    assert got == {1: ("VALUE_OVERWRITTEN", "C", None), 2: ("MAPPING_REVIEW_REQUIRED", "C", None), 3: ("VALUE_OVERWRITTEN", "C", 6)}

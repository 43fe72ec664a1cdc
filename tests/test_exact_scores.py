"""Exact scores by joins against plain text search."""

import re

import pyarrow as pa
import pytest

from tracequarry.operators import retrieval
from tracequarry.plans import catalogue, registry

DOCS = [
    (1, "The CustomerMapper maps xcustomermapper2 customermappercustomermapper.", ["Case 7", None]), (2, "a bc de fghij", ["A-1", "a1"]), (3, "abc de fghij", []), (4, None, ["maps"]), (5, "", None),
    (6, "aaaaaaaaaaaaaaaa aaaaaaa", ["", "--"]), (7, "see customermapper maps it, then repositories", ["MAPS it"]), (8, "é de é", ["é"]), (9, "x" * 3000 + " é, é?", ["fghij"]),
]
ASKED = [(1, "CustomerMapper maps"), (2, "bc de f"), (3, "aaaaaaa"), (4, None), (5, "c d"), (6, "repositories repositories"), (7, "customermapper repositories"), (8, "é"), (9, "nowhere1 found"), (10, "mapper maps it"), (11, "é, é"), (12, ""), (13, "case-7 a1"), (14, "x")]


def plain(q, t, ids):
    q, t = q.lower(), (t or "").lower()
    compact = lambda x: re.sub("[^a-z0-9]", "", (x or "").lower())
    by_id = 90 * sum(1 for i in ids or [] if compact(i) and compact(i) in compact(q))
    return (80 if q in t else 0) + sum(min(12 * t.count(x), 48) for x in set(re.findall(r"[a-z0-9_./:-]+", q))) + by_id


def test_exact_scores(spark):
    docs, asked = spark.createDataFrame(DOCS, "doc_id int, text string, identifiers array<string>"), spark.createDataFrame(ASKED, "query_id int, text string")
    want = {(i, j): float(plain(q, t, ids)) for i, q in ASKED for j, t, ids in DOCS if q and plain(q, t, ids) > 0}
    assert {(r.query_id, r.doc_id): r.score for r in retrieval.exact_scores(docs, asked).collect()} == want
    assert retrieval.exact_scores(docs.limit(0), asked).count() == 0 and retrieval.exact_scores(docs, asked.limit(0)).count() == 0


def test_a_batch_of_questions_meets_no_exchange(spark, monkeypatch):
    """Questions of checked size are matrices in tasks (before, every document's words met every question's by exchanges); a larger batch is joined, with equal scores."""
    docs, asked = spark.createDataFrame(DOCS, "doc_id int, text string, identifiers array<string>"), spark.createDataFrame(ASKED, "query_id int, text string")
    blocks = retrieval.exact_scores(docs, asked)
    assert "Join" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(blocks.collect())
    best = sorted(retrieval.top(retrieval.exact_scores(docs.coalesce(1), asked, 1), 1).collect())
    assert best == sorted(retrieval.top(blocks, 1).collect()) and len(best) < len(want)
    monkeypatch.setattr(retrieval, "CELLS", 1)
    joined = retrieval.exact_scores(docs, asked)
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString() and sorted(joined.collect()) == want


def test_blocks_end_by_rows_and_by_text():
    batch = pa.RecordBatch.from_arrays([pa.array(["aaa", None, "b", "c" * 9, "d", ""])], ["t"])
    assert [b.num_rows for b in retrieval.blocks(batch, "t", 2, 4)] == [2, 1, 1, 2] and [b.num_rows for b in retrieval.blocks(batch, "t", 4)] == [4, 2]
    assert list(retrieval.blocks(batch.slice(0, 0), "t", 2)) == []


def test_given_tokens(spark):
    docs = spark.createDataFrame([(1, "of maps of")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "Of maps", ["maps"]), (2, "nothing", None), (3, "maps of", ["absent", "OF"]), (4, "s o", [])], "query_id int, text string, tokens array<string>")
    assert [(r.query_id, r.score) for r in retrieval.exact_scores(docs, asked).orderBy("query_id").collect()] == [(1, 92.0), (3, 104.0), (4, 80.0)]


def test_a_name_is_registered_once():
    assert {"graph_impact", "attribute_impact"} <= set(catalogue.queries())
    with pytest.raises(ValueError):

        @registry.query()
        def graph_impact(spark, d):
            raise AssertionError

"""Hybrid searches in blocks against the same searches over all pairs, which exchange every pair of a question and a document."""

import random

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import text as tx
from tracequarry.operators import hybrid, retrieval

WORDS = "cust type mapper update CAS-12 a.b the of ordér x_1 zebra Release".split()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(i, None if i == 7 else "" if i == 8 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9)))) for i in range(120)] + [(120 + i, "the update of CAS-12, now") for i in range(25)]
    asked = [(1, "the update of CAS-12"), (2, "a.b x_1"), (3, None), (4, ""), (5, "zebra"), (6, "cust type mapper the nothing"), (9, "—")]
    tokens = F.coalesce(tx.search_tokens(F.col("text")), F.array().cast("array<string>"))
    return tuple(spark.createDataFrame(r, f"{k} long, text string").withColumn("tokens", tokens) for r, k in ((rows, "doc_id"), (asked, "query_id")))


def told(found):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in found.collect())


@pytest.mark.parametrize("boosted", [True, False])
def test_fused_in_blocks(spark, texts, boosted, monkeypatch):
    documents, queries = texts
    dense = spark.createDataFrame([(q, (q * 31 + 7 * r) % 150, r) for q in (1, 2, 6) for r in range(1, 6)], "query_id long, doc_id long, rank int")
    want = told(hybrid._fused_whole(documents, queries, dense, 10, boosted, 60, 9))
    found, open_ = hybrid._fused_in_blocks(documents, queries, dense, 10, boosted, 60, 9)
    assert told(found) == want and not open_ and len(want) > 30
    # coarse rounding makes ranks equal: such queries are open, and ranked as a whole
    found, open_ = hybrid._fused_in_blocks(documents, queries, dense, 3, boosted, 60, 3)
    assert open_ and told(hybrid.fused_search(documents, queries, dense, 3, boosted, 60, 3)) == told(hybrid._fused_whole(documents, queries, dense, 3, boosted, 60, 3))
    monkeypatch.setattr(hybrid, "CELLS", 0)
    assert hybrid._fused_in_blocks(documents, queries, dense, 10, boosted, 60, 9) is None and told(hybrid.fused_search(documents, queries, dense, 10, boosted)) == want


def test_pairs_below_the_floor_leave_no_block(spark, texts, monkeypatch):
    documents, queries = texts
    documents = documents.withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "test_baseline").when(F.col("doc_id") % 3 == 1, "release"))
    rng = random.Random(6)
    vectors = spark.createDataFrame([(i, None if i == 9 else [rng.random() - 0.5 for _ in range(4)]) for i in range(100)], "doc_id long, vector array<double>").where("doc_id <> 9")
    asked = vectors.where("doc_id in (1, 2, 6)").withColumnRenamed("doc_id", "query_id")
    known = documents.select("doc_id", "kind", F.lit("cust").alias("baseline"))
    run = lambda: hybrid.linear_scores(documents, queries, vectors, asked)
    search = lambda scores: told(hybrid.linear_search(scores, known, queries, digits=7))
    few, got = run().count(), search(run())
    monkeypatch.setattr(hybrid, "CELLS", 0)
    assert few < run().count() and got == search(run()) and len(got) > 10


def test_texts_meet_vectors_in_one_exchange(spark, texts):
    documents, queries = texts
    documents = documents.withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "test_baseline"))
    vectors = spark.createDataFrame([(i, [1.0, i / 7]) for i in range(60)], "doc_id long, vector array<double>")
    asked = vectors.where("doc_id in (1, 2, 6)").withColumnRenamed("doc_id", "query_id")
    runs = hybrid.linear_scores(documents.drop("tokens"), queries, vectors, asked)  # before, tokens had to be there, and were exchanged and sorted with the texts
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "kind", *(F.round(c, 9) for c in ("exact", "bm25", "vector"))).collect()), key=str)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert rows(runs) == rows(hybrid.linear_scores(documents, queries, vectors, asked)) and "Sort" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_run_counts(spark):
    corpus = spark.createDataFrame([("a b a",), (None,), ("",), ("b-1 — b",)], "t string").repartition(3)
    for most in (0, 9):
        got = {r["term"]: r["df"] for r in retrieval._run_counts(corpus, most).collect()}
        assert got == {"a": 1, "b": 2, "b-1": 1, None: 4}
    assert retrieval._run_counts(corpus).agg(F.sum("n")).first()[0] == 5

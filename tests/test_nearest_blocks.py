"""Neighbours from blocks of a fixed size."""

import numpy as np

from tracequarry.operators import retrieval


def test_blocks_stay_small_and_ties_hold(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", (40, 8))
    rng = np.random.default_rng(1)
    v = rng.integers(-1, 2, (300, 3)).astype(float)  # many equal vectors, some null vectors
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>")
    asked = vectors.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = v / np.where(length > 0, length, 1)
    score = np.round(unit[::10] @ unit.T, 9) + 0.0
    want = {10 * q: sorted((i for i in range(300) if i != 10 * q), key=lambda i: (-score[q, i], i))[:7] for q in range(30)}
    got = {}
    for r in retrieval.nearest(vectors, asked, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == want
    assert retrieval.similarities(vectors, asked).count() == 30 * 299


def test_blocks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", (10, 5))
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1000)], "doc_id long, vector array<double>")
    asked = vectors.where("doc_id < 50").withColumnRenamed("doc_id", "query_id")
    plan = retrieval.nearest(vectors, asked, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "), 100)" in plan and "), 10)" in plan  # 100 blocks of vectors, 10 of queries
    assert retrieval.nearest(vectors, asked, 2).count() == 100

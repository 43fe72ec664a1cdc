"""The whole fusions count documents beyond the vector rank of 50."""

import math

from tracequarry.plans import catalogue


def test_low_vector_ranks_count(spark, tmp_path):
    spark.createDataFrame([(i, "needle here" if i == 65 else "filler") for i in range(70)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [math.cos(i / 100), math.sin(i / 100)]) for i in range(70)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "needle")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = lambda name: {r["doc_id"]: r["score"] for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}[65]
    assert abs(first("hybrid_linear_whole") - (0.6 + 0.4 * math.cos(0.65) / math.cos(0.01))) < 2e-6
    assert abs(first("hybrid_rrf_whole") - (1 / 61 + 1 / 125)) < 2e-6

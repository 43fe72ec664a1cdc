"""Scores of files are summed where the files lie; rows that say one thing twice count once."""

from __future__ import annotations

from tracequarry.operators import reviews as rv


def _tables(spark, paths):
    asked = spark.createDataFrame([(1, "validate customer email"), (2, "customer")], "requirement int, text string")
    concepts = spark.createDataFrame([(1, "Customer"), (1, "Customer")], "requirement int, concept string")
    files = spark.createDataFrame([(p, "Customer", ["validateEmail", "validateEmail"], "email validate customer") for p in paths], "path string, class_name string, methods array<string>, content string")
    return asked, concepts, files, spark.createDataFrame([(1, "a"), (1, "a")], "requirement int, path string")


def test_file_scores_leave_a_task_as_sums(spark):
    plan = rv.file_scores(*_tables(spark, ["a", "b"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # counts of distinct words sent every match of a word through exchanges, several times


def test_file_scores_of_a_path_in_several_rows(spark):
    want = [(1, "a", 1, 3, 1, 2, True, 21), (1, "b", 1, 3, 1, 0, True, 16), (2, "a", 1, 1, 0, 0, False, 8), (2, "b", 1, 1, 0, 0, False, 8)]
    for paths in (["a", "b"], ["a", "b", "a"]):
        assert sorted(map(tuple, rv.file_scores(*_tables(spark, paths)).collect())) == want

"""What work grows with: how many tasks share it and what may be broadcast, read from partitions and plans."""

import os

import pytest
from pyspark.sql import functions as F

from tracequarry import store
from tracequarry.operators import corpus, evidence, mappings
from tracequarry.plans import knowledge, sources

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@given
def test_sources_are_made_in_several_tasks(spark):
    assert sources._corpus(spark, DATA).rdd.getNumPartitions() >= 4


def test_only_counted_rows_are_broadcast(spark):
    left, right = spark.range(20).withColumn("v", F.lit("x")), spark.range(5)
    assert "BuildRight" in plan(store.with_few(left, right, "id")) and "BroadcastHashJoin" not in plan(store.with_few(left, right, "id", few=4))
    assert store.with_few(left, right, "id").count() == store.with_few(left, right, "id", few=4).count() == 5


@given
def test_words_of_sources_are_not_broadcast(spark):
    names = spark.createDataFrame([("name1",), ("name1",), ("code",)], "attribute string")
    found = corpus.occurrences(sources._corpus(spark, DATA), names)
    assert "BuildLeft" not in plan(found)


def test_clauses_are_not_broadcast(spark):
    documents, attributes = spark.createDataFrame([(1, "Region: accept AB.")], "doc_id int, text string"), spark.createDataFrame([(1, "region")], "doc_id int, attribute string")
    assert "BroadcastHashJoin" not in plan(evidence.value_instructions(documents, attributes))


def test_graph_attributes_are_counted_as_they_are_listed(spark):
    asked = [(1, "Name", None), (2, "name", "A"), (3, "name", "a"), (3, "NAME", None), (4, "name", "a"), (4, "name", "b"), (5, "none", None), (6, None, None), (7, "age", "c"), (7, "name", "a"), (8, "name", "z")]
    nodes = [(10, "name", "a"), (10, "NAME", "A"), (11, "name", "b"), (12, "name", "a"), (12, "name", "b"), (13, "age", "C"), (13, "name", "a"), (14, "name", None), (None, "name", "a"), (15, None, "a")]
    m, n = spark.createDataFrame(asked, "mapping_id int, attribute string, owner string"), spark.createDataFrame(nodes, "node_id int, attribute string, owner string")
    listed = {(r.mapping_id, len(r.node_ids), r.status) for r in mappings.graph_attributes(m, n).collect()}
    assert {tuple(r) for r in mappings.graph_attribute_counts(m, n).collect()} == listed


def test_conditions_of_code_meet_once(spark):
    stated = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("A").alias("lhs"), F.lit("<").alias("op"), F.lit(1.0).alias("threshold"))
    applied = spark.range(1000).select(F.lit("a").alias("lhs"), F.lit("<=").alias("op"), F.lit(1.0).alias("threshold"))
    out = evidence.threshold_mismatches(stated, applied)
    assert out.count() == 3 and plan(out).count("HashAggregate") >= 4  # of conditions, then of pairs


@given
def test_texts_with_entities_are_read_in_several_tasks(spark):
    found = knowledge.entity_kinds(spark, DATA)
    assert "REPARTITION_BY_NUM" in plan(found) and plan(found).count("Exchange") == 1  # ranks need no exchange of entities

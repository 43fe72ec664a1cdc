"""Queries take all rows of their tables."""

import os

import pytest
from pyspark.sql import functions as F

from tracequarry.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


def given(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def run(spark, name):
    return catalogue.queries()[name](spark, DATA)


def test_semi_anti_validate(spark):
    assert run(spark, "semi_anti_validate").where("found").count() == given(spark, "orders").select("o_custkey").distinct().count()


def test_shared_component(spark):
    assert run(spark, "shared_component").count() == given(spark, "lineitem").select("l_partkey").distinct().count()


def test_endpoint_evidence(spark):
    lines = given(spark, "lineitem")
    found = {r["l_suppkey"]: r["n_tickets"] for r in run(spark, "endpoint_evidence").collect()}
    assert found == {r["l_suppkey"]: r["n"] for r in lines.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n")).collect()}


def test_baseline_pair_compare(spark):
    assert run(spark, "baseline_pair_compare").count() == given(spark, "orders").select("o_custkey").distinct().count()


def test_source_path_lookup(spark):
    part = given(spark, "part")
    asked = part.where("p_size < 40").select("p_brand").distinct()
    assert run(spark, "source_path_lookup").agg(F.sum("n_rows")).first()[0] == part.where("p_size > 10").join(asked, "p_brand", "left_semi").count()

"""neighbourhood deals what its few seeds reach into many tasks."""

from tracequarry.operators import graph
from tracequarry.plans import catalogue


def test_rows_of_one_seed_are_many_tasks(spark, tmp_path):
    write = lambda name, rows, shape: spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    write("supplier", [(i, 1, -1.0) for i in range(3)], "s_suppkey long, s_nationkey int, s_acctbal double")
    write("customer", [(i, 1) for i in range(200)], "c_custkey long, c_nationkey int")
    write("orders", [(i, i) for i in range(200)], "o_orderkey long, o_custkey long")
    write("lineitem", [(0, 0)], "l_orderkey long, l_partkey long")
    found = catalogue.queries()["neighbourhood"](spark, str(tmp_path))
    assert found.count() == 3 * (1 + 200 + 200)
    # one nation has all rows; before, they came from its one task
    assert max(r["n"] for r in found.groupBy(catalogue.F.spark_partition_id().alias("p")).count().withColumnRenamed("count", "n").collect()) < 3 * 401 * 0.6


def test_plain_edges_are_not_stored(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i % 3}", f"c{i}") for i in range(30)] + [(f"c{i % 30}", f"o{i}") for i in range(300)] + [(f"o{i}", f"p{i % 7}") for i in range(300)] + [(None, "c1"), ("c1", None)], "source string, target string")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("x",), (None,)], "seed string")
    told = lambda df: sorted(map(tuple, df.collect()))
    want = told(graph.reach(edges, seeds, 3, undirected=True))
    assert len(want) > 200 and max(d for _, _, d in want) == 3
    written, kept = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name, keep=False: written.append(name) or kept(df, name, keep))
    monkeypatch.setattr(graph, "FEW", 2)  # the first hop is sent to every task, the others meet steps in an exchange
    assert told(graph.reach(edges, seeds, 3, undirected=True, plain=True)) == want and set(written) == {"hops"}  # before, all edges were exchanged twice and stored both ways
    back = told(graph.reach(edges, spark.createDataFrame([("p1",)], "seed string"), 9, reverse=True, plain=True))
    assert len(back) > 40 and back == told(graph.reach(edges, spark.createDataFrame([("p1",)], "seed string"), 9, reverse=True))

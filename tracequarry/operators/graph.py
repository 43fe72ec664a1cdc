"""Property graphs as two frames, nodes(id, label, name, project) and edges(source, target, type), and bounded traversal.

Frontiers are joined to the edges one hop at a time, for all seeds at once; each hop is a table in the shared folder of
spark.checkpoint.dir, so a lost executor costs one hop at most. What reach returns has seeds x reached nodes rows by nature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.store import hot_keys, met, scratch, stored

#: Rows of a frontier that are sent to every task.
FEW = 10_000


def reach(edges: DataFrame, seeds: DataFrame, hops: int, reverse: bool = False, undirected: bool = False, plain: bool = False) -> DataFrame:
    """(seed, node, depth): every node within so many hops of each seed, once, at its least depth. seeds(seed).

    plain: edges are tables as they lie, so every hop reads them there, and none are stored. Of either kind a hop exchanges only steps that begin between its least and its greatest node."""
    spark = edges.sparkSession
    forward = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    backward = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    steps = (forward.unionByName(backward) if undirected else backward if reverse else forward).where("a is not null and b is not null")
    seen = frontier = stored(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).where("seed is not null").distinct(), "hops")
    with scratch(spark):
        if not plain:
            steps = stored(steps.distinct().repartition("a"), "steps")  # read once for every hop
        for depth in range(1, hops + 1):
            n, least, most = frontier.agg(F.count("*"), F.min("node"), F.max("node")).first()
            if n == 0:
                break
            at = frontier.select("seed", F.col("node").alias("a"))
            ahead = steps.where(F.col("a").between(F.lit(least), F.lit(most))).join(F.broadcast(at) if n <= FEW else at, "a").select("seed", F.col("b").alias("node")).distinct()
            frontier = stored(ahead.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "hops", keep=True)
            seen = seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, seeds: DataFrame, up_types: list[str], down_types: list[str], up: int = 8, down: int = 5) -> DataFrame:
    """(seed, node, direction, depth): callers up to `up` hops against edges of some types, then what depends on those along others."""
    above = reach(edges.where(F.col("type").isin(up_types)), seeds, up, reverse=True)
    starts = above.select(F.col("node").alias("seed")).distinct()
    below = reach(edges.where(F.col("type").isin(down_types)), starts, down).where("depth > 0")
    joined = above.select("seed", F.col("node").alias("via"), F.col("depth").alias("d1")).join(below.select(F.col("seed").alias("via"), "node", F.col("depth").alias("d2")), "via")
    joined = joined.groupBy("seed", "node").agg(F.min(F.col("d1") + F.col("d2")).alias("depth")).withColumn("direction", F.lit("BUSINESS"))
    return above.where("depth > 0").withColumn("direction", F.lit("CALLERS")).select("seed", "node", "direction", "depth").unionByName(joined.select("seed", "node", "direction", "depth"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that links of either direction reach. Labels pass along edges and jump to their label's label.

    A node with many links, or a label of many nodes, is met by broadcasting its one row; see store.met. Links without an end count for nothing.
    """
    with scratch(edges.sparkSession):
        ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a is not null and b is not null")
        both = stored(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
        hubs = hot_keys(both, "b")
        labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
        while True:
            heard = met(both, labels.select(F.col("node").alias("b"), "component"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
            passed = stored(labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("component")), "labels")
            ahead = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
            now = met(passed, ahead, "component", hot_keys(passed, "component"))
            now = stored(now.select("node", "was", F.least("component", "next").alias("component")), "labels", keep=True)
            if now.where("was <> component").isEmpty():
                return now.select("node", "component")
            labels = now.select("node", "component")


def merge_nodes(graphs: list[DataFrame]) -> DataFrame:
    """Nodes of several graphs; of those with one id the last graph's counts."""
    every = None
    for order, g in enumerate(graphs):
        g = g.withColumn("_order", F.lit(order))
        every = g if every is None else every.unionByName(g, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in ("id", "_order")]
    return every.groupBy("id").agg(F.max_by(F.struct(*rest), "_order").alias("n")).select("id", "n.*")


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, callee, basis) of calls(caller, owner, receiver_type, name) among methods(id, owner, name): by own class, by the
    receiver's type, else by a name that only one class has. Calls of oneself are left out."""
    own = methods.select(F.col("id").alias("own_id"), F.col("owner"), F.col("name"))
    typed = methods.select(F.col("id").alias("typed_id"), F.col("owner").alias("receiver_type"), F.col("name"))
    unique = methods.groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("unique_id")).where("n = 1").drop("n")
    joined = calls.join(own, ["owner", "name"], "left").join(typed, ["receiver_type", "name"], "left").join(unique, "name", "left")
    callee = F.when(F.col("receiver_type").isNull(), F.coalesce("own_id", "unique_id")).otherwise(F.coalesce("typed_id", "unique_id"))
    basis = F.when(callee == F.col("own_id"), "SAME_CLASS").when(callee == F.col("typed_id"), "RECEIVER_TYPE").otherwise("UNIQUE_NAME")
    return joined.select("caller", callee.alias("callee"), basis.alias("basis")).where("callee is not null and callee <> caller").distinct()


def keep_main_component(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Of homonymous seeds (name, node, project, methods) those whose component has most projects, then methods, then nodes; ties all stay."""
    comp = components(links)
    placed = seeds.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("name", "component").agg(F.countDistinct("project").alias("projects"), F.sum("methods").alias("methods_all"), F.count("*").alias("nodes"))
    best = F.rank().over(Window.partitionBy("name").orderBy(F.desc("projects"), F.desc("methods_all"), F.desc("nodes")))
    return placed.join(sizes.withColumn("_r", best).where("_r = 1").select("name", "component"), ["name", "component"])


def focused(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, types: list[str], between_projects: str = "DEPENDS_ON") -> DataFrame:
    """The edges of some types that begin or end at a seed, and the edges between the projects of what they touch. seeds(id)."""
    ids = seeds.select("id").distinct()
    some = edges.select("source", "target", "type").where(F.col("type").isin(types))
    near = some.join(ids, F.col("source") == F.col("id"), "left_semi").unionByName(some.join(ids, F.col("target") == F.col("id"), "left_semi")).distinct()
    touched = near.select(F.col("source").alias("id")).unionByName(near.select(F.col("target").alias("id"))).distinct()
    projects = nodes.join(touched, "id", "left_semi").select("project").where("project is not null").distinct()
    deps = edges.select("source", "target", "type").where(F.col("type") == between_projects)
    deps = deps.join(projects, F.col("source") == F.col("project"), "left_semi").join(projects, F.col("target") == F.col("project"), "left_semi")
    return near.unionByName(deps.distinct()).distinct()


def dependency_paths(calls: DataFrame, changes: DataFrame, first: int = 8) -> DataFrame:
    """(flow, symbol, path, rank): the ways from a call tree's root down to a changed symbol, the first of each tree in the order of its calls.

    calls(id, parent, pos, symbol, verified): nodes of trees whose roots have no parent and give the flow its id; a node that is not verified, or that
    repeats a symbol above it, ends its way. changes(symbol). Equal paths of a tree count once. All trees go down a level at a time; a level is a table."""
    spark = calls.sparkSession
    good = calls.where("verified and symbol is not null").select("id", "parent", "pos", "symbol")
    found = None
    with scratch(spark):
        good = stored(good, "calls")
        level = stored(good.where("parent is null").select(F.col("id").alias("flow"), "id", "symbol", F.array("symbol").alias("path"), F.array("pos").alias("places")), "paths", keep=True)
        while not level.isEmpty():
            found = level if found is None else found.unionByName(level)
            below = good.select(F.col("id").alias("_id"), F.col("parent").alias("_p"), "pos", F.col("symbol").alias("_s"))
            down = level.join(below, level["id"] == below["_p"]).where("not array_contains(path, _s)")
            level = stored(down.select("flow", F.col("_id").alias("id"), F.col("_s").alias("symbol"), F.concat("path", F.array("_s")).alias("path"), F.concat("places", F.array("pos")).alias("places")), "paths", keep=True)
    ways = (level if found is None else found).join(changes.select("symbol").distinct(), "symbol", "left_semi").groupBy("flow", "symbol", "path").agg(F.min("places").alias("places"))
    rank = F.row_number().over(Window.partitionBy("flow").orderBy("places", "path"))
    return ways.select("flow", "symbol", "path", rank.alias("rank")).where(F.col("rank") <= first)


def evidence_edges(references: DataFrame, covers: DataFrame, possibly: DataFrame, maps: DataFrame) -> DataFrame:
    """(source, target, type, evidence, classification): what is verified and what is inferred as edges of different types, each (source, target, evidence)."""
    kinds = [(references, "REFERENCES_JIRA", "VERIFIED"), (covers, "COVERS_JIRA", "VERIFIED"), (possibly, "POSSIBLY_COVERS_JIRA", "INFERRED"), (maps, "MAPS_TO_ATTRIBUTE", "VERIFIED")]
    every = None
    for df, kind, sure in kinds:
        one = df.select(F.col("source").cast("string"), F.col("target").cast("string"), F.lit(kind).alias("type"), "evidence", F.lit(sure).alias("classification"))
        every = one if every is None else every.unionByName(one)
    return every.where("source is not null and target is not null").distinct()

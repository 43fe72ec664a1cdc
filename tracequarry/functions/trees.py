"""JSON trees as leaf tables, comparisons and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.store import scratch, stored


def signature(json: Column) -> Column:
    """A digest that does not depend on the order of keys."""
    return F.sha2(F.to_json(F.parse_json(json)), 256)


def kind(value: Column) -> Column:
    """bool, int, float, str, list, dict or null of a variant."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), "null")
        .when(schema.startswith("ARRAY"), "list")
        .when(schema.startswith("OBJECT"), "dict")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "BIGINT", "int")
        .when(schema.startswith("DECIMAL") | (schema == "DOUBLE"), "float")
        .otherwise("str")
    )


def depths(json: Column) -> Column:
    """How many containers stand in one another at most in a JSON text; 0 of a scalar, null of null."""
    plain = F.regexp_replace(F.regexp_replace(json, r"\\.", ""), '"[^"]*"', "")
    brackets = F.split(F.regexp_replace(plain, r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(brackets, start, step, lambda a: a["most"])


def _opened(level: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of a level (keep, path, kind, v) replaced by the children of their containers."""
    each = level.where(F.col("kind").isin("list", "dict")).alias("s").lateralJoin(level.sparkSession.tvf.variant_explode(F.col("s.v").outer()).alias("e"))
    step = F.when(F.col("s.kind") == "list", F.concat("s.path", F.lit("["), F.col("e.pos").cast("string"), F.lit("]"))).when(F.col("s.path") == "", F.col("e.key")).otherwise(F.concat("s.path", F.lit("."), F.col("e.key")))
    return each.select(*[F.col(f"s.`{c}`") for c in keep], step.alias("path"), F.col("e.value").alias("v")).withColumn("kind", kind(F.col("v")))


def nodes(payloads: DataFrame, key: str, json: str, depth: int | None = None) -> DataFrame:
    """(key, path, kind, value, opened) of every node of every tree; path is like a.b[0].c and the root's is empty.

    One level is opened in each round, which reads the level above from a table and moves no rows between tasks; text that is not JSON has no nodes. Without
    `depth`, one pass over the payloads finds how deep they are and every level is opened; with it, containers at that depth
    stay unopened, with their JSON text as value.
    """
    level = payloads.select(F.col(key), F.lit("").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null").withColumn("kind", kind(F.col("v")))
    if depth is None:
        depth = payloads.agg(F.max(depths(F.col(json)))).first()[0] or 0
    container = F.col("kind").isin("list", "dict")
    out = None
    with scratch(payloads.sparkSession):
        for d in range(depth + 1):
            level = stored(level, "json-level", keep=True)  # so that no tree is read again for the levels below
            own = level.select(key, "path", "kind", F.to_json("v").alias("value"), (container if d < depth else F.lit(False)).alias("opened"))
            out = own if out is None else out.unionByName(own)
            if d < depth:
                level = _opened(level, [key])
    return out


def leaves(payloads: DataFrame, key: str, json: str, depth: int | None = None) -> DataFrame:
    """(key, path, value) of every leaf, containers left unopened at `depth` among them; empty containers have none.

    A leaf of depth d passes d explodes in one pass: a row that needs no further opening goes through as it is, so the JSON is
    parsed once however deep it is.
    """
    if depth is None:
        depth = payloads.agg(F.max(depths(F.col(json)))).first()[0] or 0
    level = payloads.select(F.col(key).alias("k"), F.lit("").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    for _ in range(depth):
        shape = F.schema_of_variant("s.v")
        is_list, is_dict = shape.startswith("ARRAY"), shape.startswith("OBJECT")
        tvf = level.sparkSession.tvf.variant_explode_outer(F.when(is_list | is_dict, F.col("s.v")).outer())
        each = level.alias("s").lateralJoin(tvf.alias("e"))
        step = F.when(F.col("e.pos").isNull(), F.col("s.path")).when(F.col("e.key").isNull(), F.concat("s.path", F.lit("["), F.col("e.pos").cast("string"), F.lit("]")))
        step = step.when(F.col("s.path") == "", F.col("e.key")).otherwise(F.concat("s.path", F.lit("."), F.col("e.key")))
        level = each.select("s.k", step.alias("path"), F.when(F.col("e.pos").isNull(), F.col("s.v")).otherwise(F.col("e.value")).alias("v"))
    value = F.to_json("v")
    return level.select(F.col("k").alias(key), "path", value.alias("value")).where(~value.isin("[]", "{}"))


def leaf_diff(pairs: DataFrame, key: str, old: str, new: str, depth: int | None = None) -> DataFrame:
    """(key, path, change, before, after) for leaves added, removed or changed between two JSON texts of a row.

    Both texts of a row are opened side by side and compared after one exchange on (key, path)."""
    if depth is None:
        deepest = pairs.agg(F.greatest(F.max(depths(F.col(old))), F.max(depths(F.col(new))))).first()[0]
        depth = deepest or 0
    side = lambda c, name: pairs.select(F.col(key), F.lit(name).alias("side"), F.col(c).alias("json"))
    both = side(old, "a").unionByName(side(new, "b")).where("json is not null").select(F.struct(key, "side").alias("of"), "json")
    each = leaves(both, "of", "json", depth)
    pick = lambda name: F.max(F.when(F.col("of.side") == name, F.struct("value")))
    met = each.groupBy(F.col(f"of.{key}").alias(key), "path").agg(pick("a").alias("a"), pick("b").alias("b"))
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(~F.col("a.value").eqNullSafe(F.col("b.value")), "CHANGED")
    return met.select(key, "path", change.alias("change"), F.col("a.value").alias("before"), F.col("b.value").alias("after")).where("change is not null")


def compare(pairs: DataFrame, key: str, expected: str, actual: str, depth: int | None = None) -> DataFrame:
    """(key, path, issue): missing and unexpected nodes at their topmost path, differing types, values and list lengths; containers left unopened at `depth` compare like values."""
    side = lambda c, name: pairs.select(F.struct(F.col(key), F.lit(name).alias("side")).alias("_of"), F.col(c).alias("_json"))
    each = nodes(side(expected, "e").unionByName(side(actual, "a")).where("_json is not null"), "_of", "_json", depth)
    pick = lambda name, c: F.max(F.when(F.col("_of.side") == name, F.struct(c)))[c]
    sides = [pick(name, c).alias(c[0] + n) for name, n in (("e", "1"), ("a", "2")) for c in ("kind", "value", "opened")]
    with scratch(pairs.sparkSession):
        both = stored(each.groupBy(F.col(f"_of.{key}").alias(key), "path").agg(*sides), "json-both", keep=True)
    up = F.regexp_replace("path", r"(\.[^.\[\]]*|\[\d+\]|^[^.\[\]]+)$", "")
    both = both.withColumn("above", F.when(F.col("path") != "", up))
    there = both.select(F.col(key).alias("_k"), F.col("path").alias("_p"), F.col("k1").isNotNull().alias("in1"), F.col("k2").isNotNull().alias("in2"))
    both = both.join(there, F.col(key).eqNullSafe(F.col("_k")) & (F.col("above") == F.col("_p")), "left")
    top = F.col("above").isNull() | (F.col("in1") & F.col("in2"))
    scalar = ~F.col("o1") & ~F.col("o2")
    size = lambda v: F.size(F.from_json(v, "array<string>"))
    issue = (
        F.when(F.col("k2").isNull() & top, "MISSING_IN_ACTUAL")
        .when(F.col("k1").isNull() & top, "UNEXPECTED_IN_ACTUAL")
        .when(F.col("k1").isNull() | F.col("k2").isNull(), None)
        .when((F.col("k1") != F.col("k2")) & (F.col("k1") != "null") & (F.col("k2") != "null"), "TYPE_MISMATCH")
        .when((F.col("k1") != F.col("k2")) | (scalar & (F.col("v1") != F.col("v2"))), "VALUE_MISMATCH")
        .when((F.col("k1") == "list") & (size(F.col("v1")) != size(F.col("v2"))), "LIST_LENGTH_MISMATCH")
    )
    return both.select(key, "path", issue.alias("issue"), F.col("v1").alias("expected"), F.col("v2").alias("actual")).where("issue is not null")

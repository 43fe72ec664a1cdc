"""Mixing sources to target weights by capped water-filling (operator 9).

Nulls: a null text has size 0; a null source is a source of its own and comes last; rows with one doc_id in one
source are taken together. Windows over the sources' rows (hundreds or thousands, not documents) are one task's work. Empty table: no rows. Other columns pass through `apply_mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.llm._store import stored

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A seeded, evenly spread text of 32 hex digits for each document."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """sources (source, weight, source_size) with its `target`: share * all sizes, split by weight; no target above epochs * source_size.

    A source is capped exactly if its cap is at most its part of what those with a lower cap for their weight leave; so one
    pass in the order of cap / weight gives the level at which the repeated resharing ends.
    """
    cap = epochs * F.col("source_size")
    lower = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.col("all_size") - F.col("used")) / (F.col("all_weight") - F.col("used_weight"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.withColumns({"all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
        .withColumns({"used": F.coalesce(F.sum(cap).over(lower), F.lit(0.0)), "used_weight": F.coalesce(F.sum("weight").over(lower), F.lit(0))})
        .withColumn("level", level)
        .withColumn("capped", cap <= F.col("weight") * F.col("level"))
        .withColumn("open_level", F.min(F.when(~F.col("capped"), F.struct("used_weight", "level"))).over(every)["level"])
        .withColumn("target", F.when(F.col("capped"), cap).otherwise(F.col("weight") * F.col("open_level")).cast("double"))
        .select("source", "weight", "source_size", "target")
    )


def mix_plan(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 9, digits: int = 3) -> DataFrame:
    """One row per source: its size, target, the whole repetitions of all its documents, and the last draw that gets one more.

    The fraction left after whole repetitions goes to the documents with the lowest draws, as long as their words stay
    within it, and to one more of the others, whose size comes nearest to what is then left. Sums by the first `digits` hex
    digits of the draw find the place where that ends, so only the documents of one such bucket for each source are ordered.
    """
    sized = documents.select("source", n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("draw"))
    sized = stored(sized.groupBy("source", "draw").agg(F.sum("size").alias("size")).withColumn("bucket", F.substring("draw", 1, digits)), "mix-sizes")
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    sources = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1)
    plan = water_fill(sources.withColumn("weight", weight), share, epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = stored(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")

    # a running sum in two levels: over the buckets, then over the draws of the bucket in which `rest` is reached
    running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = _by_source(sums.withColumn("sum", running), plan.select("source", "rest"))
    below = ends.where((F.col("rest") > 0) & (F.col("sum") <= F.col("rest"))).groupBy("source").agg(F.max(F.struct(F.concat("bucket", F.lit("g")).alias("last"), "sum")).alias("end"))
    edge = ends.where((F.col("sum") > F.col("rest")) & (F.col("sum") - F.col("size") < F.col("rest")))
    edge = edge.select("source", F.col("bucket").alias("edge"), (F.col("sum") - F.col("size")).alias("before"), "rest")
    within = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0))
    inside = _by_source(sized, edge).where(F.col("bucket") == F.col("edge")).withColumn("sum", F.col("before") + within)
    inside = inside.where(F.col("sum") <= F.col("rest")).groupBy("source").agg(F.max(F.struct(F.col("draw").alias("last"), "sum")).alias("end"))
    # "g" is above every hex digit: with it a whole bucket counts as drawn
    end = below.unionByName(inside).groupBy("source").agg(F.max("end").alias("end"))
    ends = stored(_by_source(plan, end, "left").select("*", "end.last", (F.col("rest") - F.coalesce("end.sum", F.lit(0))).alias("short")).drop("end"), "mix-ends")
    off = F.abs(F.col("size") - F.col("short"))
    extra = _by_source(sized, ends.select("source", "last", "short")).where((F.col("draw") > F.coalesce("last", F.lit(""))) & (off < F.col("short")))
    extra = extra.groupBy("source").agg(F.min(F.struct(off.alias("off"), "draw"))["draw"].alias("extra"))
    return stored(_by_source(ends, extra, "left"), "mix-extras")


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), how).drop("_of")


def with_repetitions(documents: DataFrame, plan: DataFrame, seed: int = 9) -> DataFrame:
    """documents with `source_size`, `target` and `repetitions`, the times that the mix takes the row; columns of these names are replaced."""
    own = documents.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    met_ = _by_source(own, plan.select("source", "source_size", "target", "whole", "last", "extra"))
    drawn = draw(F.col("doc_id"), seed)
    more = F.coalesce(drawn <= F.col("last"), F.lit(False)) | F.coalesce(drawn == F.col("extra"), F.lit(False))
    kept = [F.col(f"row.`{c}`") for c in documents.columns if c.lower() not in ("source_size", "target", "repetitions")]
    return met_.select(*kept, "source_size", "target", (F.col("whole") + more.cast("long")).alias("repetitions"))


def mixed(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of documents as often as the mix takes it."""
    plan = mix_plan(documents, **how)
    own = documents.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    taken = with_repetitions(own, plan, how.get("seed", 9)).where(F.col("repetitions") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repetitions")))).select("_row.*")

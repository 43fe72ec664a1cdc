"""Comparison, history and quality of versioned rows, snapshots and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def differs(old: Column, new: Column) -> Column:
    """Whether two texts differ; null and the empty text are the same."""
    return ~F.nullif(old, F.lit("")).eqNullSafe(F.nullif(new, F.lit("")))


def latest(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def compare_versions(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], last: str) -> DataFrame:
    """keys, change (ADDED, REMOVED, CHANGED, UNCHANGED) and changed fields; of rows with one key the last by `last` counts, of those
    with equal `last` the one with the greatest fields, so that reruns agree."""

    def one(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.max(F.struct(F.col(last).alias("last"), F.struct(*fields).alias("fields")))["fields"].alias(side))

    both = one(old, "old").join(one(new, "new"), keys, "full_outer")
    changed = F.array_compact(F.array(*[F.when(differs(F.col(f"old.{f}").cast("string"), F.col(f"new.{f}").cast("string")), f) for f in fields]))
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.size("changed") > 0, "CHANGED").otherwise("UNCHANGED")
    return both.withColumn("changed", changed).withColumn("change", change).withColumn("changed", F.when(F.col("change") == "CHANGED", F.col("changed")).otherwise(F.array().cast("array<string>")))


def timeline(df: DataFrame, family: list[str], order: list[Column | str], fields: list[str]) -> DataFrame:
    """df with `status` (INITIAL, CHANGED, UNCHANGED) and `changed`, the fields that differ from the version before."""
    w = Window.partitionBy(*family).orderBy(*order)
    changed = F.array_compact(F.array(*[F.when(differs(F.lag(F.col(f).cast("string")).over(w), F.col(f).cast("string")), f) for f in fields]))
    first = F.row_number().over(w) == 1
    return df.withColumn("changed", F.when(first, F.array().cast("array<string>")).otherwise(changed)).withColumn("status", F.when(first, "INITIAL").when(F.size("changed") > 0, "CHANGED").otherwise("UNCHANGED"))


def quality_issues(rows: DataFrame, source: str, target: str, null_rule: str, transform: str) -> DataFrame:
    """(source, issue): competing targets, conflicting null rules and transforms, duplicate definitions of one source."""
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    by = rows.groupBy(norm(source).alias("source")).agg(
        F.countDistinct(norm(target)).alias("targets"), F.countDistinct(norm(null_rule)).alias("rules"), F.countDistinct(norm(transform)).alias("transforms"),
        F.count("*").alias("n"), F.countDistinct(norm(target), norm(null_rule), norm(transform)).alias("kinds"),
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("targets") > 1, "COMPETING_TARGETS"), F.when(F.col("rules") > 1, "CONFLICTING_NULL_RULES"),
            F.when(F.col("transforms") > 1, "CONFLICTING_TRANSFORMS"), F.when(F.col("n") > F.col("kinds"), "DUPLICATE_ACTIVE_DEFINITION"),
        )
    )
    return by.where((F.col("source") != "") & (F.col("n") > 1)).select("source", F.explode(issues).alias("issue"))


def conflicts(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys with more than one distinct combination of fields, and how many."""
    return rows.groupBy(*keys).agg(F.countDistinct(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])).alias("variants")).where("variants > 1")


def consolidate(rows: DataFrame, key: Column, order: Column, definition: list[str], source: str) -> DataFrame:
    """One row per key: its first definition, its distinct sources in order, its rows, and whether definitions conflict."""
    body = F.struct(*definition)
    return rows.groupBy(key.alias("case_key")).agg(
        F.min(F.struct(order.alias("order"), body.alias("body")))["body"].alias("definition"), F.sort_array(F.collect_set(source)).alias("sources"),
        F.count("*").alias("n_rows"), (F.countDistinct(body) > 1).alias("conflict"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, complete: bool = True) -> DataFrame:
    """(path, change) of two file sets (path, content): ADDED, REMOVED, MODIFIED, UNCHANGED; if a scan was incomplete, files on one side only are UNVERIFIED."""
    digest = lambda df, name: df.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.sha2("content", 256).alias(name))
    both = digest(old, "a").join(digest(new, "b"), "path", "full_outer")
    one_sided = lambda kind: F.lit(kind if complete else "UNVERIFIED")
    return both.select("path", F.when(F.col("a").isNull(), one_sided("ADDED")).when(F.col("b").isNull(), one_sided("REMOVED")).when(F.col("a") != F.col("b"), "MODIFIED").otherwise("UNCHANGED").alias("change"))


def fingerprint(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a digest of their files that does not depend on order. Contents shrink to digests before they are gathered."""
    leaf = F.sha2(F.concat_ws("\0", F.col("path"), F.sha2("content", 256)), 256)
    # a sum of digest prefixes gathers in the map-side combine, so no task holds a file list
    part = lambda k: F.conv(F.substring(leaf, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    return files.groupBy(*keys).agg(F.sha2(F.concat_ws(":", F.count("*"), *[F.sum(part(k)) for k in range(4)]), 256).alias("fingerprint"))


def capture(current: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append to history (keys, fingerprint, version): a new version only where the fingerprint changed."""
    last = history.groupBy(*keys).agg(F.max_by("fingerprint", "version").alias("was"), F.max("version").alias("version"))
    fresh = current.join(last, keys, "left").where(~F.col("fingerprint").eqNullSafe(F.col("was")))
    return fresh.select(*keys, "fingerprint", (F.coalesce("version", F.lit(0)) + 1).alias("version"))


def set_changes(rows: DataFrame, group: list[str], version: str, item: str) -> DataFrame:
    """Items that each version of a group added, dropped and kept against the version before."""
    sets = rows.groupBy(*group, version).agg(F.sort_array(F.collect_set(item)).alias("items"))
    before = F.lag("items").over(Window.partitionBy(*group).orderBy(version))
    out = sets.withColumn("before", before).where("before is not null")
    return out.select(*group, version, F.array_except("items", "before").alias("added"), F.array_except("before", "items").alias("removed"), F.size(F.array_intersect("items", "before")).alias("n_kept"))


def risk(df: DataFrame, rules: dict[str, tuple[Column, int]], complete: Column | None = None) -> DataFrame:
    """df with points (at most 100), reasons and level: HIGH from 60, MEDIUM from 25, else LOW; UNKNOWN if evidence is incomplete."""
    points = F.lit(0)
    for test, worth in rules.values():
        points = points + F.when(test, worth).otherwise(0)
    out = df.withColumn("points", F.least(F.lit(100), points)).withColumn("reasons", F.array_compact(F.array(*[F.when(test, name) for name, (test, _) in rules.items()])))
    level = F.when(F.col("points") >= 60, "HIGH").when(F.col("points") >= 25, "MEDIUM").otherwise("LOW")
    return out.withColumn("level", level if complete is None else F.when(~complete, "UNKNOWN").otherwise(level))


def header_rows(grid: DataFrame, aliases: DataFrame, required: list[str], first: int = 25) -> DataFrame:
    """(doc, sheet, row): of the first rows of a sheet the one with most known headers that has all required; ties go to the first.

    grid(doc, sheet, row, col, value), aliases(alias, canonical)."""
    key = F.regexp_replace(F.lower(F.trim("value")), "[^a-z0-9]", "")
    known = grid.where(F.col("row") <= first).withColumn("alias", key).join(aliases, "alias")
    rows = known.groupBy("doc", "sheet", "row").agg(F.collect_set("canonical").alias("found"))
    rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, required)), "found")) == 0).withColumn("n", F.size("found"))
    return latest(rows, ["doc", "sheet"], F.desc("n"), F.asc("row"))


def rows_of_grid(grid: DataFrame, aliases: DataFrame, required: list[str]) -> DataFrame:
    """Cells below each sheet's header as rows with canonical columns: doc, sheet, row and one column per canonical name."""
    key = F.regexp_replace(F.lower(F.trim("value")), "[^a-z0-9]", "")
    heads = header_rows(grid, aliases, required).select("doc", "sheet", F.col("row").alias("head"))
    placed = grid.join(heads, ["doc", "sheet"])
    names = placed.where("row = head").withColumn("alias", key).join(aliases, "alias").select("doc", "sheet", "col", "canonical")
    names = latest(names, ["doc", "sheet", "canonical"], F.asc("col"))
    cells = placed.where("row > head").join(names, ["doc", "sheet", "col"])
    return cells.groupBy("doc", "sheet", "row").pivot("canonical").agg(F.min("value"))

"""A table that is brought up to date as a whole, in buckets by key: each version rewrites only the buckets whose rows changed.

folder/data/version=<n>/bucket=<b> holds the rows of a bucket that version n wrote; folder/manifest/version=<n> says for each bucket which version's rows count,
how many they are and their digest. A version exists once its manifest is there, which is written last, so a write that fails leaves the table as it was and
the next one writes over what it left. A reader takes one version for as long as it is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.store import removed, scratch, stored

_MANIFEST = "bucket int, data_version int, n_rows long, digest string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _numbers(spark: SparkSession, folder: str, name: str = "") -> list[int]:
    """The versions below a folder; with a name, those that hold a file of that name."""
    if not _exists(spark, folder):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.split("=")[1]) for n in found if n.startswith("version=") and (not name or _exists(spark, f"{folder}/{n}/{name}")))


def known_versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a table whose writing ended, oldest first."""
    return _numbers(spark, f"{folder}/manifest", "_SUCCESS")


def _digest(columns: list[str]) -> Column:
    """A digest of a bucket's rows in any order: sums of two 64-bit hashes of each."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", F.count("*").cast("string"), total(1), total(2))


def manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest/version={version}")


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the last; an error if there is none."""
    have = known_versions(spark, folder)
    version = have[-1] if version is None and have else version
    if version not in have:
        raise ValueError(f"{folder} has no version {version}")
    rows = manifest(spark, folder, version).where("n_rows > 0").select("bucket", "data_version").collect()  # one for each bucket
    schema = spark.read.parquet(f"{folder}/schema").schema
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/data/version={r['data_version']}/bucket={r['bucket']}" for r in rows])


def write_version(folder: str, incoming: DataFrame, key: str, buckets: int = 64, delete_missing: bool = True) -> dict[str, int]:
    """Brings the table at `folder` up to date with incoming and returns version, inserted, updated, deleted, unchanged and written_buckets.

    A row of incoming inserts its key or replaces it; keys that incoming lacks go, or stay without delete_missing. Of rows with one key the greatest counts; a null key is an
    error. All versions of a table have the same key, columns and number of buckets. If nothing changed no version is made. What a bucket holds is
    compared by its digest, so unchanged buckets are neither read nor written; one writer at a time."""
    spark, columns = incoming.sparkSession, incoming.columns
    have = known_versions(spark, folder)
    new = have[-1] + 1 if have else 0
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    with scratch(spark):
        one = incoming.groupBy(key).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in columns if c != key])).alias("_r")).select(key, "_r.*") if len(columns) > 1 else incoming.distinct()
        rows = stored(one.select(*columns).withColumn("bucket", place), "snapshot-incoming")
        if not rows.where(F.col(key).isNull()).isEmpty():
            raise ValueError(f"a row has no {key}")
        digest = rows.groupBy("bucket").agg(F.count("*").alias("n_rows"), _digest(columns).alias("digest"))
        every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        now = every.join(digest, "bucket", "left").select("bucket", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("digest", F.lit("")).alias("digest"))
        if have:
            was = manifest(spark, folder, have[-1]).select("bucket", "data_version", F.col("digest").alias("_d"), F.col("n_rows").alias("_n"))
        else:
            was = every.select("bucket", F.lit(0).alias("data_version"), F.lit("").alias("_d"), F.lit(0).cast("long").alias("_n"))
        compared = stored(now.join(was, "bucket"), "snapshot-compared")
        touched = [r[0] for r in compared.where(F.col("digest") != F.col("_d")).select("bucket").collect()]  # one for each bucket
        counts = {"version": new - 1, "inserted": 0, "updated": 0, "deleted": 0, "unchanged": sum(r[0] for r in compared.where(F.col("digest") == F.col("_d")).select("n_rows").collect()), "written_buckets": 0}
        old = read_version(spark, folder).withColumn("bucket", place).where(F.col("bucket").isin(touched)) if have else rows.limit(0)
        side = lambda df, name: df.select(key, "bucket", F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name))
        both = stored(side(old, "o").join(side(rows.where(F.col("bucket").isin(touched)), "n"), [key, "bucket"], "full_outer"), "snapshot-both")
        told = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
        change = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "deleted" if delete_missing else "unchanged").when(told("o") == told("n"), "unchanged").otherwise("updated")
        for r in both.groupBy(change.alias("change")).count().collect():
            counts[r["change"]] += r["count"]
        if have and not (counts["inserted"] or counts["updated"] or counts["deleted"]):
            return counts
        kept = F.col("n") if delete_missing else F.coalesce("n", "o")
        result = stored(both.where(kept.isNotNull()).select(kept.alias("r"), "bucket").select("r.*", "bucket"), "snapshot-result")
        if not have:
            result.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{folder}/schema")
        result.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={new}")
        final = result.groupBy("bucket").agg(F.count("*").alias("n"), _digest(columns).alias("d"))
        is_touched = F.col("bucket").isin(touched)
        rows_of = compared.join(final, "bucket", "left").select(
            "bucket", F.when(is_touched, new).otherwise(F.col("data_version")).cast("int").alias("data_version"),
            F.when(is_touched, F.coalesce("n", F.lit(0))).otherwise(F.col("_n")).alias("n_rows"), F.when(is_touched, F.coalesce("d", F.lit(""))).otherwise(F.col("_d")).alias("digest"),
        )
        rows_of.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={new}")
    return counts | {"version": new, "written_buckets": len(touched)}


def forget(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Deletes all but the last `keep` versions, and the rows that these do not need; returns the versions of rows that went."""
    have = known_versions(spark, folder)
    last = have[-keep:]
    needed = {r[0] for v in last for r in manifest(spark, folder, v).where("n_rows > 0").select("data_version").distinct().collect()}
    for v in have[:-keep]:
        removed(spark, f"{folder}/manifest/version={v}")
    gone = [v for v in _numbers(spark, f"{folder}/data") if v not in needed]
    for v in gone:
        removed(spark, f"{folder}/data/version={v}")
    return gone

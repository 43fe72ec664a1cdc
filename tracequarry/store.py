"""Intermediate tables in the folder that the whole cluster shares, their removal, sizes, and joins that spread hot keys."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset, and Spark runs on this machine alone, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = spark.conf.get("spark.tracequarry.ownDir", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.conf.set("spark.tracequarry.ownDir", folder)
    return folder.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at its end, but for those stored with keep, which belong to the scope around it."""
    scopes = _local.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            removed(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as a Parquet table into the shared folder and reads it again: lineage ends here, a lost executor costs nothing that is written."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    scopes = _local.__dict__.get("scopes", [])
    of = scopes[:-1] if keep else scopes
    if of:
        of[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame, text: str = "text") -> int:
    """About how many bytes df has: of file scans and what is made of them the size of the files, else the counted bytes of its text."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if sizes and all(s < 1 << 62 for s in sizes):  # a leaf without statistics stands for 2^63 - 1
        return sum(sizes)
    return df.agg(F.sum(F.octet_length(F.col(text) if df.schema[text].dataType.simpleString() in ("string", "binary") else F.col(text).cast("string")))).first()[0] or 0


def parts(df: DataFrame, each: int, least: int = 1, text: str = "text") -> int:
    """How many parts of about `each` bytes df has, at least the session's shuffle partitions."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size_of(df, text) // each)


def spread(df: DataFrame, *keys: str, each: int = 1 << 18) -> DataFrame:
    """df dealt by its keys into parts of about `each` bytes of its files, before work that is heavy for a row: a small file is one task otherwise."""
    return df.repartition(parts(df, each), *keys)


def with_few(left: DataFrame, right: DataFrame, key: str | list[str], few: int = 10_000, how: str = "inner") -> DataFrame:
    """left joined with right, which is broadcast if it is counted to have no more than `few` rows; else both meet by a sorted exchange.

    For frames whose size Spark can't tell from their files (exploded rows, long texts made of short rows), so that it never broadcasts these."""
    if right.limit(few + 1).count() <= few:
        return left.join(F.broadcast(right), key, how)
    return left.hint("merge").join(right, key, how)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def hot_keys(df: DataFrame, key: str, parts: int = 64, few: int = 4096) -> list:
    """Values of key that hold more than 1/parts of all rows: fewer than `parts`, by that very bound. Of up to `few` rows none is hot."""
    total = df.count()
    if total <= few:
        return []
    most = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_m")).orderBy(F.desc("_m")).limit(parts).collect()
    return [r[key] for r in most if r["_m"] * parts > total]


def met(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """left joined with right on key, which is unique in right. The rows of right for hot keys, at most as many as `hot` names, are
    broadcast, so those of left stay where they are; all others meet in an exchange."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return left.where(~is_hot).join(right.where(~is_hot), key, how).unionByName(few)

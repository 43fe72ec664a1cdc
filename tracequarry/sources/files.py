"""Files as frames, and frames as files. Nothing is read on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark, else ISO-8859-1."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """external_id, content_hash, modified, text of each file below path; temporary office files (~$) are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    raw = raw.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))
    return raw.select(F.col("path").alias("external_id"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"), decoded(F.col("content")).alias("text"))


def source_corpus(spark: SparkSession, path: str, excluded: tuple[str, ...] = ("target", "build", "node_modules", ".git"), pattern: str = "*.java") -> DataFrame:
    """path and content of source files outside excluded folders."""
    out = folder(spark, path, pattern)
    inside = F.arrays_overlap(F.split("external_id", "/"), F.array(*map(F.lit, excluded)))
    return out.where(~inside).select(F.col("external_id").alias("path"), F.col("text").alias("content"))


def csv_rows(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """file and one column for each logical name, found by its aliases among the headers (letters and digits compared)."""
    raw = spark.read.csv(path, header=True)
    key = lambda c: "".join(ch for ch in c.lower() if ch.isalnum())
    have = {key(c): c for c in raw.columns}
    pick = lambda names: F.coalesce(*[F.col(f"`{have[n]}`") for n in names if n in have], F.lit(None).cast("string"))
    return raw.select(F.col("_metadata.file_path").alias("file"), *[pick(names).alias(c) for c, names in columns.items()])


#: Logical columns of a test suite and the headers that stand for them.
TEST_COLUMNS = {
    "test_id": ("testid", "id", "testcaseid"),
    "scenario": ("scenario", "testscenario", "title", "description"),
    "input": ("input", "testdata", "inputcountrycode"),
    "expected": ("expected", "expectedoutcome", "expectedresult"),
    "jira": ("jira", "ticket", "jiraid"),
    "attribute": ("attribute", "javaattribute", "field"),
    "operation": ("operation", "endpoint"),
}


def test_suite(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of CSV files: rows with an id and a scenario or an expected outcome. A suite never proves an execution."""
    rows = csv_rows(spark, path, TEST_COLUMNS)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    cases = rows.where(~blank("test_id") & ~(blank("scenario") & blank("expected")))
    return cases.withColumn("attribute", F.substring_index("attribute", ".", -1)).withColumn("execution_status", F.lit("NOT_VERIFIED"))


def json_cases(spark: SparkSession, path: str) -> DataFrame:
    """file, row and case (JSON text) of test cases in JSON files: a list, or one under test_cases or tests."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    pick = F.coalesce(F.try_variant_get("v", "$.test_cases", "array<variant>"), F.try_variant_get("v", "$.tests", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    return raw.select("file", F.posexplode(pick).alias("row", "c")).select("file", "row", F.to_json("c").alias("case"))


def junit(spark: SparkSession, path: str) -> DataFrame:
    """name, class_name and status of each testcase of JUnit XML files."""
    shape = T.StructType([T.StructField(n, T.StringType()) for n in ("_name", "_classname", "failure", "error", "skipped")])
    raw = spark.read.format("xml").option("rowTag", "testcase").schema(shape).load(path)
    status = F.when(F.col("failure").isNotNull() | F.col("error").isNotNull(), "FAILED").when(F.col("skipped").isNotNull(), "SKIPPED").otherwise("PASSED")
    return raw.select(F.col("_name").alias("name"), F.col("_classname").alias("class_name"), status.alias("status"))


def openapi_operations(specs: DataFrame) -> DataFrame:
    """(spec, path, method, refs) of OpenAPI JSON texts (spec, text)."""
    v = specs.select("spec", F.try_variant_get(F.try_parse_json("text"), "$.paths", "variant").alias("paths")).where("paths is not null").alias("o")
    tvf = specs.sparkSession.tvf
    each = v.lateralJoin(tvf.variant_explode(F.col("o.paths").outer()).alias("p")).lateralJoin(tvf.variant_explode(F.col("p.value").outer()).alias("m"))
    rows = each.where(F.col("m.key").isin("get", "post", "put", "patch", "delete")).select("o.spec", F.col("p.key").alias("path"), F.col("m.key").alias("method"), F.to_json("m.value").alias("body"))
    return rows.select("spec", "path", "method", F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit(r'"\$ref":"#/components/schemas/(\w+)"'), F.lit(1)))).alias("refs"))


def schema_refs(value: object) -> list[str]:
    """Names of the local schemas that a parsed OpenAPI value refers to, each once, in the order of the text; read with a stack."""
    out, todo = {}, [value]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            ref = node.get("$ref")
            if isinstance(ref, str) and ref.startswith("#/components/schemas/") and ref.rsplit("/", 1)[-1]:
                out[ref.rsplit("/", 1)[-1]] = True
        if isinstance(node, (dict, list)):
            todo += list(node.values() if isinstance(node, dict) else node)[::-1]
    return list(out)


def openapi_schemas(specs: DataFrame) -> DataFrame:
    """(spec, kind, path, method, name, type) of OpenAPI JSON texts (spec, text): REQUEST and RESPONSE schemas of each operation, found by a walk over its
    body and responses, and each PROPERTY (name, type) of each schema (path). A reference inside other text is none. Texts that are no JSON objects have no rows."""

    def rows(text: str | None) -> list[tuple]:
        try:
            spec = json.loads(text or "")
        except (ValueError, RecursionError):
            return []
        out = []
        part = lambda node, name: node.get(name) if isinstance(node, dict) and isinstance(node.get(name), dict) else {}
        for path, methods in part(spec, "paths").items():
            for method, operation in (methods if isinstance(methods, dict) else {}).items():
                if method in ("get", "post", "put", "patch", "delete") and isinstance(operation, dict):
                    out += [(kind, path, method, n, None) for kind, at in (("REQUEST", "requestBody"), ("RESPONSE", "responses")) for n in schema_refs(operation.get(at))]
        for name, schema in part(part(spec, "components"), "schemas").items():
            for field, kind in part(schema, "properties").items():
                told = kind.get("type") if isinstance(kind, dict) else None
                out.append(("PROPERTY", name, None, field, told if isinstance(told, str) else next(iter(schema_refs(kind)), None)))
        return out

    names = ["kind", "path", "method", "name", "type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rows(t) for t in batch.column("text").to_pylist()]
            owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = list(zip(*[r for f in found for r in f], strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("spec").take(owner), *[pa.array(c, pa.string()) for c in flat]], ["spec", *names])

    kind = specs.schema["spec"].dataType.simpleString()
    return specs.select("spec", "text").mapInArrow(run, f"spec {kind}, " + ", ".join(f"{n} string" for n in names))


def ticket_feed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed issue JSON lines as flat rows with their metadata appended to the requirement."""
    fields = "struct<summary:string,description:string,status:string,updated:timestamp>"
    reader = spark.readStream if stream else spark.read
    raw = reader.schema(f"key string, fields {fields}").json(path)
    meta = F.to_json(F.struct(F.col("fields.status").alias("status"), F.col("fields.updated").alias("updated")))
    return raw.select(F.col("key").alias("external_id"), F.col("fields.summary").alias("title"), F.concat_ws("\n", F.coalesce("fields.description", F.lit("")), F.concat(F.lit("Jira metadata: "), meta)).alias("content"), F.col("fields.updated").alias("version_token"))


def write_report(sheets: dict[str, DataFrame], folder_out: str) -> None:
    """One CSV folder with a header for each sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder_out}/sheet={name}")


def finalise(manifest: DataFrame, keys: list[str], folder_out: str) -> None:
    """Writes each manifest once with its digest; an existing folder is an error."""
    body = F.to_json(F.struct(*sorted(manifest.columns)))
    manifest.select(*keys, body.alias("manifest_json"), F.sha2(body, 256).alias("manifest_sha256")).write.mode("errorifexists").parquet(folder_out)


def drifted(spark: SparkSession, folder_out: str) -> DataFrame:
    """Manifests whose text no longer has its digest."""
    return spark.read.parquet(folder_out).where(F.sha2("manifest_json", 256) != F.col("manifest_sha256"))

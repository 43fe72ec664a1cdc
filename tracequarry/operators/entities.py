"""Entities that documents name: tickets, attributes, scenarios, endpoints, verbs, classes, methods, releases, tests, commits and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.text import MONTHS, TICKET, without_section

#: The labels that name an entity of a kind, as patterns.
LABELS = {
    "attributes": "attribute(?:s)?|field(?:s)?|property|properties",
    "scenarios": r"scenario(?:s)?|test\s+scenario(?:s)?",
    "endpoints": r"endpoint(?:s)?|api\s+(?:route|path|endpoint)(?:s)?",
    "classes": "class(?:es)?|controller(?:s)?|service(?:s)?|mapper(?:s)?|repository|repositories",
    "methods": "method(?:s)?|function(?:s)?",
    "release_names": r"release(?:\s+(?:name|version))?",
    "tests": r"test(?:\s+case)?(?:s)?|test_name|test\s+name",
    "commits": r"commit(?:\s+(?:id|sha|hash))?|git\s+commit",
}
FILE_LABELS = r"file(?:s)?|changed\s+file(?:s)?|path(?:s)?"
#: How many of each kind are listed, and the order of kinds.
LIMITS = {
    "jira_ids": 100, "attributes": 100, "scenarios": 100, "endpoints": 100, "http_methods": 10, "classes": 100,
    "methods": 100, "release_names": 20, "tests": 100, "commits": 100, "files": 200,
}
#: Types of sources whose paths are no endpoints, and those whose prose is read.
MAPPING_TYPES, PROSE_TYPES = ("MAPPING", "MAPPING_FOLDER"), ("REQUIREMENT", "JIRA")
_START = r"(?:^|[\r\n]|(?<=[.;]))\s*"
_VERBS = "GET|POST|PUT|PATCH|DELETE"


def _every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def labelled(text: Column, labels: str) -> Column:
    """Values after a label at the start of a line or sentence, up to the end of the sentence or the next label; commas part them."""
    found = _every(text, rf"(?id){_START}(?:{labels})\s*[:=-]\s*(.+?)(?=\s*(?:[.;]|$|[A-Za-z][A-Za-z _-]{{1,30}}\s*[:=]))")
    return F.flatten(F.transform(found, lambda v: F.split(F.trim(v), r"\s*,\s*")))


def file_names(text: Column) -> Column:
    """Values after a label of files, in which dots belong to names: up to the end of the line, a semicolon or the next label."""
    others = "|".join(["JIRA", *LABELS.values(), r"HTTP\s+Method", r"Test\s+Scenario(?:s)?", FILE_LABELS, "Change"])
    found = _every(text, rf"(?id){_START}(?:{FILE_LABELS})\s*[:=-]\s*(.+?)(?=\s*(?:[;\r\n]|$)|\s+(?:{others})\s*[:=])")
    return F.flatten(F.transform(found, lambda v: F.transform(F.split(F.trim(v), r"\s*,\s*"), lambda x: F.regexp_replace(F.trim(x), r"\.+$", ""))))


def extracted(documents: DataFrame, first: dict[str, int] | None = LIMITS) -> DataFrame:
    """(doc_id, kind, rank, entity): what each document names, in the order of its rules and then of the text, each once, case aside.

    documents(doc_id, source_type, text). Tickets by their keys, verbs (upper case) and months with a year (written as names) wherever they stand, the rest by labels (see LABELS) and by strong forms: verb and path,
    names of roles (SomeService), calls without arguments, names of tests, commit hashes; in requirements also what prose says of an attribute and its class, outside a
    section Out of scope. Mappings have no endpoints. Blanks, quotes and signs around a value go. `first` keeps so many of each kind, None all. Nulls name nothing;
    rows of one doc_id are read as one document."""
    t, kind = F.coalesce("text", F.lit("")), F.upper(F.trim(F.coalesce("source_type", F.lit(""))))
    nothing = F.array().cast("array<string>")
    told = F.when(kind.isin(*PROSE_TYPES), without_section(t, r"out\s+of\s+scope")).otherwise("")
    documents = documents.select("doc_id", "source_type", "text", told.alias("_prose"))  # cut once for all that reads it
    prose = F.col("_prose")
    named = r"\s+(?:attribute|field|property)\s+(?:named|called)\s+"
    added = r"(?i)\b(?:add|create|introduce|support)\s+(?:a\s+)?(?:new\s+)?([A-Z][A-Za-z0-9_$]*)" + named + r"([A-Za-z_$][\w$]*)\b"
    belongs = r"\b([a-z_$][A-Za-z0-9_$]*)\s+belongs\s+to\s+(?:the\s+)?([A-Z][A-Za-z0-9_$]*)\b"
    routes = F.filter(F.concat(_every(t, rf"(?i)\b(?:{_VERBS})\s+(/[^\s,;]+)"), labelled(t, LABELS["endpoints"])), lambda p: p.startswith("/"))
    kinds = {
        "jira_ids": _every(t, TICKET, 0),
        "attributes": F.concat(labelled(t, LABELS["attributes"]), _every(prose, added, 2), _every(prose, belongs, 1), _every(prose, r"(?i)\b(?:new\s+)?" + named.removeprefix(r"\s+") + r"([A-Za-z_$][\w$]*)\b")),
        "scenarios": labelled(t, LABELS["scenarios"]),
        "endpoints": F.when(kind.isin(*MAPPING_TYPES), nothing).otherwise(routes),
        "http_methods": F.transform(_every(t, rf"(?i)\b({_VERBS})\b"), F.upper),
        "classes": F.concat(labelled(t, LABELS["classes"]), _every(prose, added, 1), _every(prose, belongs, 2), _every(t, r"\b[A-Z][A-Za-z0-9]*(?:Controller|Service|Mapper|Repository|Client|Gateway)\b", 0)),
        "methods": F.concat(labelled(t, LABELS["methods"]), _every(t, r"\b(?:[A-Za-z_$][\w$]*\.)?([a-z_$][\w$]*)\s*\(\s*\)")),
        "release_names": F.concat(F.transform(_every(t, rf"(?i)\b(?:{MONTHS})\s+20\d{{2}}\b", 0), F.initcap), labelled(t, LABELS["release_names"])),
        "tests": F.concat(labelled(t, LABELS["tests"]), _every(t, r"\b[A-Z][A-Za-z0-9_]*(?:Test|Tests)\b", 0)),
        "commits": F.concat(labelled(t, LABELS["commits"]), _every(t, r"(?i)\bcommit\s+([0-9a-f]{7,40})\b")),
        "files": file_names(t),
    }
    lists = documents.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("values")) for k, v in kinds.items()])).alias("l"))
    each = lists.select("doc_id", "l.kind", F.posexplode("l.values").alias("pos", "raw"))
    clean = each.withColumn("entity", F.regexp_replace(F.regexp_replace(F.trim("raw"), r"^[`'\" ,;:]+|[`'\" ,;:]+$", ""), r"^\s+|\s+$", "")).where("entity <> ''")
    once = clean.groupBy("doc_id", "kind", F.lower("entity").alias("_k")).agg(F.min(F.struct("pos", "entity")).alias("f"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("f.pos", "f.entity"))).select("doc_id", "kind", "rank", F.col("f.entity").alias("entity"))
    if first is None:
        return ranked
    most = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    return ranked.where(F.col("rank") <= F.coalesce(most[F.col("kind")], F.lit(1 << 30)))

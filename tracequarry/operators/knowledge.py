"""Evidence for a batch of questions from several sources: which documents there are, which of them answer, and which may be quoted."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.retrieval import HEADS
from tracequarry.store import scratch, stored

#: Words that make a question one about history, about a change, about a release; domains; and words that name no subject.
HISTORY = ("release", "history", "historical", "tested", "testing", "baseline", "version", "executed", "covered", "jira", "jiras")
CHANGE = ("change", "changed", "where")
RELEASE = ("release", "tested", "testing")
DOMAINS = ("employee", "student", "customer")
GENERIC = (
    *DOMAINS, "person", "persons", *HISTORY, "scenario", *CHANGE, "which", "what",
    "eligibility", "eligible", "classification", "validation", "calculation", "amount",
)

#: In which bucket a type of source is listed; other types have a bucket of their own name in lower case.
BUCKETS = {
    "REQUIREMENT": "requirements", "JIRA": "requirements", "TEST": "tests", "TEST_REPORT": "tests", "CODE_CHANGE": "code_changes",
    "ARCHITECTURE": "architecture", "API": "api_docs", "RELEASE": "releases",
}


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def constraints(queries: DataFrame, history: tuple = HISTORY, change: tuple = CHANGE, release: tuple = RELEASE, domains: tuple = DOMAINS, generic: tuple = GENERIC) -> DataFrame:
    """(query_id, kind, term): what a document must have to be quoted for a question about history; other questions have no rows.

    queries(query_id, tokens array, subjects array, intents array). A kind is met by any one of its terms: DOMAIN by a domain that the question names, SUBJECT by one of
    its subjects that is no generic word, RELEASE (no term) by a release and tests. Nulls are empty."""
    have = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    q = queries.select("query_id", have("tokens").alias("t"), have("subjects").alias("s"), have("intents").alias("i"))
    historical = F.arrays_overlap("t", _words(history)) | F.arrays_overlap("i", _words(history))
    asked = q.withColumn("h", historical).where(F.col("h") | F.arrays_overlap("t", _words(change)))
    kind = lambda df, name, terms: df.select("query_id", F.lit(name).alias("kind"), F.explode(terms).alias("term"))
    parts = [
        kind(asked, "DOMAIN", F.array_intersect("t", _words(domains))),
        kind(asked, "SUBJECT", F.array_except("s", _words(generic))),
        kind(asked.where(F.col("h") & F.arrays_overlap("t", _words(release))), "RELEASE", F.array(F.lit(None).cast("string"))),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def grounded(ranked: DataFrame, required: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of ranked whose document meets every kind that its question requires: a division of what is required by what is there.

    ranked(query_id, doc_id, ...), required as of constraints, documents(doc_id, tokens array, release, n_tests), one row for each doc_id. A release named unknown release
    or none is none. Questions that require nothing keep all their rows; a document that is not there meets nothing."""
    pairs = ranked.select("query_id", "doc_id").distinct()
    needs = required.groupBy("query_id").agg(F.countDistinct("kind").alias("n"))
    wanted = pairs.join(required, "query_id")
    named = required.where("kind <> 'RELEASE' and term is not null").select("term").distinct()
    if named.limit(HEADS + 1).count() <= HEADS:  # a document keeps those of its tokens that are required before anything is exploded
        few = F.broadcast(named.agg(F.collect_set("term").alias("_few")))  # one row
        terms = documents.crossJoin(few).select("doc_id", F.explode(F.array_intersect("tokens", "_few")).alias("term"))
    else:
        terms = documents.select("doc_id", F.explode("tokens").alias("term")).distinct()
    by_term = wanted.where("kind <> 'RELEASE'").join(terms, ["doc_id", "term"], "left_semi").select("query_id", "doc_id", "kind")
    known = ~F.lower(F.trim("release")).isin("unknown release", "none", "") & (F.col("n_tests") > 0)
    released = documents.where(F.coalesce(known, F.lit(False))).select("doc_id")
    by_release = wanted.where("kind = 'RELEASE'").join(released, "doc_id", "left_semi").select("query_id", "doc_id", "kind")
    met = by_term.unionByName(by_release).groupBy("query_id", "doc_id").agg(F.countDistinct("kind").alias("m"))
    free = ranked.join(needs, "query_id", "left_anti")
    whole = met.join(needs, "query_id").where("m = n").select("query_id", "doc_id")
    return free.unionByName(ranked.join(needs.select("query_id"), "query_id", "left_semi").join(whole, ["query_id", "doc_id"], "left_semi").select(*free.columns))


def _told(*lines: Column) -> Column:
    """Lines that are not null or blank, one below the other."""
    return F.array_join(F.filter(F.array(*lines), lambda x: F.trim(x) != ""), "\n")


def registry_documents(scenarios: DataFrame, baselines: DataFrame, tests: DataFrame, tickets: DataFrame) -> DataFrame:
    """(document_id, kind, scenario_id, title, text, tickets, n_tests): a document for each scenario, for each of its releases with the tests that belong to it, and
    for each test in each release that it belongs to, or by itself where its release is gone.

    scenarios(scenario_id, code, name, description, http_method, endpoint, ticket), baselines(baseline_id, scenario_id, name, release_version, version), tests(test_id,
    scenario_id, baseline_id, code_version, name, status, tickets array), tickets(ticket, title, requirement). A test belongs to a release of its scenario by its id or
    by its version; one that does both ways counts once. An orphan names a release that its scenario does not have; it may belong to others by
    version as well. Tests are listed in order of their ids. Rows of scenarios that are not there make no documents. Nulls are left out of texts."""
    with scratch(scenarios.sparkSession):
        b = baselines.select("baseline_id", "scenario_id", F.col("name").alias("b_name"), F.col("version"), F.coalesce("release_version", "version").alias("b_release"))
        keys = F.array_sort(F.array_distinct(F.filter(F.transform("tickets", lambda x: F.upper(F.trim(x))), lambda x: x != "")))
        t = tests.select("test_id", "scenario_id", F.col("baseline_id").alias("of"), "code_version", F.col("name").alias("t_name"), "status", F.coalesce(keys, F.array().cast("array<string>")).alias("keys"))
        ids = lambda on: t.join(b, on).select(t["test_id"], b["baseline_id"])
        same = t["scenario_id"] == b["scenario_id"]
        related = stored(ids(same & (t["of"] == b["baseline_id"])).unionByName(ids(same & (t["code_version"] == b["version"]))).distinct(), "registry-related", keep=True)
        orphans = t.where("of is not null").join(b.select("scenario_id", F.col("baseline_id").alias("of")), ["scenario_id", "of"], "left_anti").select("test_id", F.lit(None).cast(related.schema["baseline_id"].dataType).alias("baseline_id"))
    told = t.select("test_id", F.posexplode("keys").alias("p", "k")).join(tickets.select(F.upper(F.trim("ticket")).alias("k"), "title", "requirement"), "k")
    lines = _told(F.concat(F.lit("JIRA "), "k"), F.concat(F.lit("JIRA title "), F.nullif("title", F.lit(""))), F.concat(F.lit("JIRA requirement "), F.nullif("requirement", F.lit(""))))
    of_test = told.groupBy("test_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", lines.alias("x")))), lambda r: r["x"]), "\n").alias("ticket_text"))

    s = scenarios.select("scenario_id", "code", F.col("name").alias("s_name"), "description", F.concat(F.lit("Endpoint "), "http_method", F.lit(" "), "endpoint").alias("where_"), F.col("ticket").alias("own"))
    columns = lambda df, key, kind, title, text, keys, n: df.select(key.alias("document_id"), F.lit(kind).alias("kind"), "scenario_id", title.alias("title"), text.alias("text"), keys.alias("tickets"), n.cast("long").alias("n_tests"))
    scenario_key = F.concat(F.lit("scenario:"), "scenario_id")
    own = F.filter(F.array(F.upper(F.trim("own"))), lambda x: x != "")
    first = columns(s, scenario_key, "scenario", F.concat("code", F.lit(" · Operation")), _told(F.concat(F.lit("Operation scenario "), "code"), F.col("s_name"), F.col("description"), F.col("where_")), own, F.lit(0))

    release = F.concat(F.coalesce("b_name", F.lit("Release")), F.lit(" V"), "b_release")
    listed = related.join(t.select("test_id", "t_name", "keys"), "test_id").groupBy("baseline_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("test_id", "t_name"))), lambda x: x["t_name"]).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"), F.count("*").alias("n"))
    nothing = F.array().cast("array<string>")
    of_release = b.join(s, "scenario_id").join(listed, "baseline_id", "left").withColumns({"names": F.coalesce("names", nothing), "keys": F.coalesce("keys", nothing)})
    text = _told(F.concat(F.lit("Release baseline for "), "code"), F.col("where_"), F.concat(F.lit("Release "), release), F.concat(F.lit("Code baseline V"), "version"), F.concat(F.lit("Test baselines "), F.array_join("names", ", ")), F.concat(F.lit("JIRAs "), F.array_join("keys", ", ")))
    second = columns(of_release, F.concat(scenario_key, F.lit(":release:"), "baseline_id"), "release", F.concat("code", F.lit(" · "), release), text, F.col("keys"), F.coalesce("n", F.lit(0)))

    each = related.unionByName(orphans).join(t, "test_id").join(s, "scenario_id").join(b.drop("scenario_id"), "baseline_id", "left").join(of_test, "test_id", "left")
    release = F.concat(F.coalesce("b_name", F.lit("Unknown Release")), F.lit(" V"), F.when(F.col("baseline_id").isNotNull(), F.col("b_release")).otherwise(F.col("code_version")))
    text = _told(F.concat(F.lit("Test baseline "), "t_name"), F.concat(F.lit("Parent scenario "), "code"), F.col("where_"), F.concat(F.lit("Release "), release), F.concat(F.lit("Status "), "status"), F.col("ticket_text"))
    key = F.concat(scenario_key, F.lit(":test:"), "test_id", F.lit(":release:"), F.coalesce(F.col("baseline_id").cast("string"), F.lit("orphan")))
    third = columns(each, key, "test_baseline", F.concat("t_name", F.lit(" · "), release), text, F.col("keys"), F.lit(1))
    return first.unionByName(second).unionByName(third)


def bucket(source_type: Column) -> Column:
    """The bucket in which a type of source is listed."""
    known = F.create_map(*(F.lit(x) for pair in BUCKETS.items() for x in pair))
    return F.coalesce(known[source_type], F.lower(source_type))


def evidence_search(queries: DataFrame, tickets: DataFrame, documents: DataFrame, matches: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(query_id, mode, bucket, source, ref): evidence for each question of a batch, each once.

    queries(query_id, project, tickets array, entities array) with the tickets and other entities that a question names, tickets(ticket, project, entities array),
    documents(doc_id, project, source_type, entities array), matches(query_id, doc_id) of a semantic search, links(entity, other) between entities, optional.
    Only rows of the question's project count; a ticket without a project counts for all. A question has authority if it names a ticket that there is, or an entity (of its
    own or of such a ticket) that a document has. Then its mode is EXACT_ENTITY: its tickets, and all documents that share an entity with what was found so far,
    with the entities of the documents that share one of the seeds, or with what links lead to from these; matches do not count. Else it is SEMANTIC: its
    matches, and all documents that share an entity with them or by a link. Entities are compared case aside; a question without any evidence has no row."""
    lower = lambda c: F.lower(F.trim(c))
    opened = lambda df, keys, c="entities": df.select(*keys, F.explode(c).alias("_e")).select(*keys, lower("_e").alias("entity")).where("entity <> ''").distinct()
    asked = queries.select("query_id", F.coalesce("project", F.lit("")).alias("project"))
    of_documents = opened(documents.withColumn("project", F.coalesce("project", F.lit(""))), ["doc_id", "project"])
    with scratch(queries.sparkSession):
        of_documents = stored(of_documents, "evidence-entities", keep=True)
        named = opened(queries, ["query_id"], "tickets").withColumnRenamed("entity", "key").join(asked, "query_id")
        known = tickets.select(lower("ticket").alias("key"), "ticket", F.col("project").alias("_p"), "entities")
        found = named.join(known, "key").where(F.col("_p").isNull() | (F.col("_p") == F.col("project")))
        found = stored(found.select("query_id", "project", "ticket", "entities"), "evidence-tickets", keep=True)
        direct = opened(queries, ["query_id"]).unionByName(opened(queries, ["query_id"], "tickets"))
        seeds = stored(direct.unionByName(opened(found, ["query_id"])).distinct().join(asked, "query_id"), "evidence-seeds")
        exact = stored(seeds.join(of_documents, ["project", "entity"]).select("query_id", "project", "doc_id").distinct(), "evidence-exact")
        authority = exact.select("query_id").unionByName(found.select("query_id")).distinct()
        scoped = matches.select("query_id", "doc_id").distinct().join(asked, "query_id").join(documents.select("doc_id", F.coalesce("project", F.lit("")).alias("project")).distinct(), ["doc_id", "project"], "left_semi")
        semantic = stored(scoped.join(authority, "query_id", "left_anti").select("query_id", "project", "doc_id"), "evidence-semantic", keep=True)
        start = exact.unionByName(semantic)
        entities = seeds.select("query_id", "project", "entity").unionByName(start.join(of_documents, ["doc_id", "project"]).select("query_id", "project", "entity")).distinct()
        if links is not None:
            ahead = links.select(lower("entity").alias("entity"), lower("other").alias("_o")).where("entity <> '' and _o <> ''").distinct()
            entities = entities.unionByName(entities.join(ahead, "entity").select("query_id", "project", F.col("_o").alias("entity"))).distinct()
        documents_of = stored(stored(entities, "evidence-discovered").join(of_documents, ["project", "entity"]).select("query_id", "doc_id").distinct(), "evidence-documents", keep=True)
        authority = stored(authority, "evidence-authority", keep=True)
    types = documents.select("doc_id", bucket(F.col("source_type")).alias("bucket"))
    rows = documents_of.unionByName(semantic.select("query_id", "doc_id")).distinct().join(types, "doc_id").select("query_id", "bucket", F.lit("DOCUMENT").alias("source"), F.col("doc_id").cast("string").alias("ref"))
    rows = rows.unionByName(found.select("query_id", F.lit(BUCKETS["JIRA"]).alias("bucket"), F.lit("TICKET").alias("source"), F.col("ticket").cast("string").alias("ref"))).distinct()
    modes = authority.withColumn("_m", F.lit(True))
    return rows.join(modes, "query_id", "left").select("query_id", F.when(F.col("_m"), "EXACT_ENTITY").otherwise("SEMANTIC").alias("mode"), "bucket", "source", "ref")


_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}:,]|[^\s\[\]{}:,"]+', re.S)


def tree_text(tree: str | None) -> str | None:
    """The plain text of a JSON tree of rich text, read token by token with a stack, so that depth does not matter.

    A text is itself, a list is its elements one below the other, empty ones too, an object is its `text` and the text of its `content`, as far as not empty, with a
    space between and none around; null is empty, other values are as written. What is no JSON gives null."""
    if tree is None:
        return None
    stack: list[list] = [["top", [], None]]  # kind, parts or fields, key

    def put(value: str, falsy: bool) -> bool:
        kind, held, key = stack[-1]
        if kind == "object":
            if key is None:
                return False
            held[key] = "" if falsy else value
            stack[-1][2] = None
        else:
            held.append(value)
        return True

    expect, end = "value", 0
    for m in _TOKENS.finditer(tree):
        token = m.group()
        if tree[end : m.start()].strip():
            return None
        end = m.end()
        kind = stack[-1][0]
        if token in "[{":
            if expect not in ("value", "value or end"):
                return None
            stack.append(["list", [], None] if token == "[" else ["object", {}, None])
            expect = "value or end" if token == "[" else "key or end"
        elif token in "]}":
            if kind != ("list" if token == "]" else "object") or expect not in ("comma", "value or end", "key or end"):
                return None
            _, held, _ = stack.pop()
            if kind == "list":
                done = "\n".join(held), not held
            else:
                done = " ".join(x for x in (held.get("text", ""), held.get("content", "")) if x).strip(), not held
            if not put(*done):
                return None
            expect = "comma"
        elif token == ",":
            if expect != "comma" or kind == "top":
                return None
            expect = "value" if kind == "list" else "key"
        elif token == ":":
            if expect != "colon":
                return None
            expect = "value"
        else:
            try:
                value = json.loads(token)
            except ValueError:
                return None
            if kind == "object" and expect in ("key", "key or end"):
                if not isinstance(value, str):
                    return None
                stack[-1][2], expect = value, "colon"
                continue
            if expect not in ("value", "value or end"):
                return None
            put("" if value is None else value if isinstance(value, str) else str(value), not value)
            expect = "comma"
    top = stack[0][1]
    return top[0] if len(stack) == 1 and len(top) == 1 and not tree[end:].strip() else None


def rich_text(trees: DataFrame, column: str = "tree", name: str = "text") -> DataFrame:
    """trees with the plain text of a JSON column of rich text, in batches; see tree_text. A column of that name is replaced."""
    kept = trees.drop(name) if name != column else trees
    out = type(kept.schema)(list(kept.schema.fields)).add(name, "string") if name != column else kept.schema
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = pa.array([tree_text(t) for t in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([told if n == name else batch.column(n) for n in names], names)

    return kept.mapInArrow(run, out)

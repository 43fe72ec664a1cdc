"""The engineering graph of a project: what its source declares, reads, writes, calls and exposes, and the business records that hang on its endpoints.

Both sides name an endpoint alike, Endpoint|project|VERB|path, and meet there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.corpus import _KINDS, Source, calls, symbols
from tracequarry.operators.graph import reach, resolve_calls
from tracequarry.store import scratch, stored

#: The verbs of mapping annotations.
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE", "RequestMapping": "ANY"}
#: The edges that lead from an endpoint on to business records.
BUSINESS = ("COVERED_BY", "CHANGED_BY", "RELEASED_IN", "TESTED_IN", "BELONGS_TO", "VERIFIES_CHANGE")


def mapped(source: Source) -> list[tuple[str, str, str]]:
    """(verb, path, method) of each method with a mapping annotation, below the path of its class."""
    prefix, out = "", []
    for i, t in enumerate(source.text):
        if t != "@" or not source.is_name(i + 1) or source.text[i + 1] not in MAPPINGS:
            continue
        k, path = i + 2, ""
        if source.text[k : k + 1] == ["("] and k in source.closes:
            inside = source.content[source.at[k] + 1 : source.at[source.closes[k]]]
            path = inside.split('"')[1] if inside.count('"') >= 2 else ""
            k = source.closes[k] + 1
        while k < len(source.text) and source.text[k] not in ("{", ";", "}"):
            if source.text[k] == "@":  # another annotation
                k = source.closes[k + 2] + 1 if source.text[k + 2 : k + 3] == ["("] and k + 2 in source.closes else k + 2
            elif source.text[k] in _KINDS:
                prefix = path
                break
            elif source.is_name(k) and source.text[k + 1 : k + 2] == ["("]:
                whole = prefix.rstrip("/") + "/" + path.lstrip("/") if prefix else path
                out.append((MAPPINGS[source.text[i + 1]], whole, source.text[k]))
                break
            else:
                k += 1
    return out


def endpoints(corpus: DataFrame) -> DataFrame:
    """path, verb, endpoint and method of each mapped method of a corpus (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mapped(Source(c or "")) for c in batch.column("content").to_pylist()]
            rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = list(zip(*[e for f in found for e in f], strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("path").take(rows), *[pa.array(c, pa.string()) for c in flat]], ["path", "verb", "endpoint", "method"])

    return corpus.select("path", "content").mapInArrow(run, "path string, verb string, endpoint string, method string")


def endpoint_path(path: Column) -> Column:
    """A path with one slash before it, single slashes inside and none behind."""
    whole = F.regexp_replace(F.concat(F.lit("/"), F.trim(F.coalesce(path, F.lit("")))), "/{2,}", "/")
    return F.when(F.length(whole) > 1, F.regexp_replace(whole, "/$", "")).otherwise(whole)


def key(label: str, *parts: str | Column) -> Column:
    return F.concat_ws("|", F.lit(label), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def endpoint_key(project: str | Column, verb: Column, path: Column) -> Column:
    return key("Endpoint", project, F.upper(F.coalesce(verb, F.lit("ANY"))), endpoint_path(path))


def _attribute(name: Column) -> Column:
    bare = F.regexp_extract(name, "^(?:get|set|is)([A-Z].*)$", 1)
    return F.when(bare != "", F.lower(bare))


def engineering_edges(corpus: DataFrame, project: str) -> DataFrame:
    """(source, target, type), distinct, of the source files of a project: CONTAINS, DECLARES, READS, WRITES, CALLS, EXPOSES and INVOKES.

    corpus(path, content); the first class of a file owns what it declares, files without one count for nothing. An accessor that a method calls reads the attribute of its own
    class if that declares it, else the attribute of that name of the project; setters write the latter. Calls are resolved by own class, by the declared type of the
    receiver or its name as a class, else by a name that only one class has. Names of attributes are told in lower case."""
    read = symbols(corpus, "classes", "fields", "methods").select("path", F.get("classes", F.lit(0))["name"].alias("owner"), "fields", "methods").where("owner is not null")
    read = stored(read, "engineering-symbols")
    root = key("Project", project)
    fields = read.select("owner", F.explode("fields").alias("f")).select("owner", F.col("f.name").alias("field"), F.col("f.type").alias("type")).distinct()
    methods = read.select("owner", F.explode("methods").alias("m")).select("owner", F.col("m.name").alias("name"), "m.body")
    own = lambda label, *names: key(label, project, *[F.col(n) for n in names])
    edge = lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    made = calls(methods.select(F.col("owner").alias("path"), F.col("name").alias("method"), "body")).select(F.col("path").alias("owner"), "method", "receiver", F.col("name").alias("called")).distinct()
    made = stored(made, "engineering-calls")
    touched = made.where("receiver is not null").select("owner", F.col("method").alias("name"), F.col("called").startswith("set").alias("writes"), _attribute(F.col("called")).alias("attribute")).where("attribute is not null").distinct()
    declared = fields.select("owner", F.lower("field").alias("attribute")).distinct().withColumn("_d", F.lit(True))
    attribute = F.when(F.col("_d") & ~F.col("writes"), own("Attribute", "owner", "attribute")).otherwise(own("Attribute", "attribute"))
    uses = touched.join(declared, ["owner", "attribute"], "left").select(own("Method", "owner", "name").alias("source"), attribute.alias("target"), F.when(F.col("writes"), "WRITES").otherwise("READS").alias("type"))
    types = fields.groupBy("owner", F.col("field").alias("receiver")).agg(F.min("type").alias("_t"))
    receiver = F.when(F.col("receiver").isNull() | (F.col("receiver") == "this"), None).otherwise(F.coalesce("_t", "receiver"))
    asked = made.join(types, ["owner", "receiver"], "left").select(own("Method", "owner", "method").alias("caller"), "owner", receiver.alias("receiver_type"), F.col("called").alias("name"))
    resolved = resolve_calls(asked, methods.select(own("Method", "owner", "name").alias("id"), "owner", "name").distinct())
    exposed = endpoints(corpus).join(read.select("path", "owner"), "path").withColumn("e", endpoint_key(project, F.col("verb"), F.col("endpoint")))
    exposed = stored(exposed, "engineering-endpoints")  # two kinds of edges come of it: files are read for it once
    kinds = [
        edge(read, root, own("Class", "owner"), "CONTAINS"), edge(fields, own("Class", "owner"), key("Attribute", project, F.col("owner"), F.lower("field")), "DECLARES"), edge(methods, own("Class", "owner"), own("Method", "owner", "name"), "DECLARES"),
        uses, edge(resolved, F.col("caller"), F.col("callee"), "CALLS"), edge(exposed, F.col("e"), own("Method", "owner", "method"), "INVOKES"), edge(exposed, root, F.col("e"), "EXPOSES"),
    ]
    return reduce(DataFrame.unionByName, kinds).distinct()


def business_edges(scenarios: DataFrame, tickets: DataFrame, baselines: DataFrame, tests: DataFrame) -> DataFrame:
    """(source, target, type), distinct: COVERED_BY, CHANGED_BY, BELONGS_TO_PROJECT, RELEASED_IN, TESTED_IN, BELONGS_TO and VERIFIES_CHANGE.

    scenarios(scenario_id, project, http_method, endpoint, tickets: keys between commas or semicolons), tickets(ticket, project, null: none), baselines(baseline_id, scenario_id, name, version), tests(test_id,
    scenario_id, baseline_id, name, tickets array). Only scenarios with a project count, and what hangs on them. A test's release is that of its baseline, else one of
    the test's own name; a release without a name is called by its version."""
    s = scenarios.where("project is not null").select("scenario_id", "project", "http_method", "endpoint", "tickets")
    keys = lambda c: F.filter(F.transform(c, lambda x: F.upper(F.trim(x))), lambda x: x != "")
    sid, edge = key("Scenario", F.col("scenario_id").cast("string")), lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    ticket = lambda c: key("Ticket", F.col(c))
    b = baselines.join(s.select("scenario_id", "project"), "scenario_id").withColumn("release", F.coalesce("name", F.concat(F.lit("Baseline "), "version")))
    names = baselines.select("baseline_id", F.col("name").alias("_n"))
    t = tests.join(s.select("scenario_id", "project"), "scenario_id").join(names, "baseline_id", "left").withColumn("release", F.coalesce("_n", "name"))
    tid = key("Test", F.col("test_id").cast("string"))
    release = key("Release", F.col("project"), F.col("release"))
    kinds = [
        edge(s, endpoint_key(F.col("project"), F.col("http_method"), F.col("endpoint")), sid, "COVERED_BY"),
        edge(s.withColumn("k", F.explode(keys(F.split("tickets", "[,;]")))), sid, ticket("k"), "CHANGED_BY"),
        edge(tickets.where("project is not null and trim(ticket) <> ''").withColumn("k", F.upper(F.trim("ticket"))), ticket("k"), key("Project", F.col("project")), "BELONGS_TO_PROJECT"),
        edge(b, sid, release, "RELEASED_IN"), edge(t, sid, tid, "TESTED_IN"), edge(t.where("release is not null"), tid, release, "BELONGS_TO"), edge(t.withColumn("k", F.explode(keys(F.col("tickets")))), tid, ticket("k"), "VERIFIES_CHANGE"),
    ]
    return reduce(DataFrame.unionByName, kinds).distinct()


def attribute_impact(code: DataFrame, business: DataFrame, up: int = 8, down: int = 5) -> DataFrame:
    """(attribute, n_methods, n_endpoints, n_scenarios, n_tickets, n_tests, n_releases) of each attribute that a method reads or writes, of any class: those methods and their callers
    over up to `up` calls, the endpoints that invoke any method from which such one is reached, and what BUSINESS edges, up to `down` of them, lead to from these endpoints.

    code as of engineering_edges, business as of business_edges. Each node counts once for an attribute; attributes of one name are one, whatever class has them."""
    used = F.col("type").isin("READS", "WRITES")
    name = F.substring_index("target", "|", -1)  # names have no |, keys of nodes do
    with scratch(code.sparkSession):
        seeds = code.where(used).select(name.alias("seed")).distinct()
        back = code.where(used | F.col("type").isin("CALLS", "INVOKES")).select(F.when(used, name).otherwise(F.col("target")).alias("source"), F.col("source").alias("target"))
        above = reach(back, seeds, up + 2)
        methods = above.where(F.col("node").startswith("Method|") & (F.col("depth") <= up + 1))
        ends = above.where(F.col("node").startswith("Endpoint|"))
        onward = business.where(F.col("type").isin(*BUSINESS)).select("source", "target").unionByName(ends.select(F.col("seed").alias("source"), F.col("node").alias("target")))
        below = reach(onward, seeds, down + 1)
        label = F.substring_index("node", "|", 1)
        count = lambda kind: F.count_if(label == kind).alias(f"n_{kind.lower()}s")
        every = methods.select("seed", "node").unionByName(below.select("seed", "node"))
        out = every.groupBy(F.col("seed").alias("attribute")).agg(*map(count, ("Method", "Endpoint", "Scenario", "Ticket", "Test", "Release")))
        return stored(out, "attribute-impact", keep=True)

"""Reviews of changes: inferred scenarios, scored files, roles of operations, risk of baseline pairs, what-if rows and evaluation of retrieval.

What is inferred keeps a name that says so. Names meet by joins on words, keys and path suffixes, so no operator pairs all with all. Nulls meet
nothing, repeated rows count once unless a docstring says otherwise, and empty tables give empty results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.text import compact, endpoint_key, family_and_version, scope_key
from tracequarry.operators import graph, versions
from tracequarry.operators.linking import best_per
from tracequarry.operators.requirements import letters
from tracequarry.store import with_few


def _tails(path: Column) -> Column:
    """Every end of a path that begins at a segment, the path itself included."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    return F.when(F.size(parts) > 0, ends)


def scenario_candidates(scenarios: DataFrame, entries: DataFrame, calls: DataFrame, candidates: DataFrame, hops: int = 6) -> DataFrame:
    """(scenario, evidence, n_methods, n_classes): scenarios whose endpoint reaches candidate methods or that declare their classes.

    scenarios(scenario, verb, path, classes), entries(verb, path, method), calls(source, target), candidates(method, owner). An endpoint is the one
    of equal verb and path, else the only one of that verb of which one path ends with the other, by segments. Callers of candidates are
    found once for all scenarios. evidence: ENDPOINT_CALL_PATH if a method is reached, else DECLARED_CLASS_OVERLAP."""
    asked = scenarios.select("scenario", F.upper("verb").alias("v"), endpoint_key(F.col("path")).alias("k")).distinct()
    open_at = entries.select(F.upper("verb").alias("v"), endpoint_key(F.col("path")).alias("k"), "method").distinct()
    known = open_at.select("v", "k").distinct()
    ends, rest = known.where("k <> '/'"), asked.join(known, ["v", "k"], "left_anti")
    longer = rest.join(ends.select("v", F.col("k").alias("full"), F.explode(_tails(F.col("k"))).alias("k")), ["v", "k"]).select("scenario", "v", F.col("full").alias("k"))
    shorter = rest.select("scenario", "v", F.explode(_tails(F.col("k"))).alias("k")).join(ends, ["v", "k"]).select("scenario", "v", "k")
    only = longer.unionByName(shorter).distinct().groupBy("scenario", "v").agg(F.count("*").alias("n"), F.min("k").alias("k")).where("n = 1").drop("n")
    starts = asked.join(known, ["v", "k"]).select("scenario", "v", "k").unionByName(only).join(open_at, ["v", "k"]).select("scenario", F.col("method").alias("node"))
    callers = graph.reach(calls, candidates.select(F.col("method").alias("seed")).distinct(), hops, reverse=True)
    reached = starts.join(callers, "node").groupBy("scenario").agg(F.countDistinct("seed").alias("n_methods"))
    simple = lambda name: F.lower(F.substring_index(name, ".", -1))
    declared = scenarios.select("scenario", F.explode("classes").alias("c")).select("scenario", simple(F.col("c")).alias("c")).distinct()
    classes = declared.join(candidates.select(F.lower("owner").alias("c")).distinct(), "c").groupBy("scenario").agg(F.count("*").alias("n_classes"))
    out = reached.join(classes, "scenario", "full_outer").na.fill(0, ["n_methods", "n_classes"])
    return out.select("scenario", F.when(F.col("n_methods") > 0, "ENDPOINT_CALL_PATH").otherwise("DECLARED_CLASS_OVERLAP").alias("evidence"), "n_methods", "n_classes")


def route_conflict(endpoint: Column, attribute: Column, routes: dict[str, set[str]]) -> Column:
    """Whether "PATCH /a/b" ends in a segment that names another known attribute than the given one. routes: attribute to its segments. A veto
    only: false proves nothing. Null endpoints have no conflict."""
    path = F.split(F.lower(F.trim(endpoint)), r"\?")[0]
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    known = F.array(*(F.lit(s) for s in sorted(set().union(*routes.values()))))
    own = reduce(lambda found, a: found | ((attribute == a) & last.isin(*sorted(routes[a]))), routes, F.lit(False))
    return F.coalesce(path.startswith("patch ") & F.array_contains(known, last) & ~F.coalesce(own, F.lit(False)), F.lit(False))


def pair_review(pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """pairs with counts of the target version's tests, points, reasons and level of review.

    pairs(pair, n_matches, endpoint_changed, db_changed, members_changed, complete), tests(pair, status). Fixed values: points 20, 25, 20, 15, 40, 20.
    A status that is none of PASS, FAIL, NOT_RUN is unknown; without complete evidence the level is UNKNOWN. Null flags are false."""
    status = F.upper(F.coalesce("status", F.lit("UNKNOWN")))
    count = lambda test, name: F.count_if(test).alias(name)
    run = tests.select("pair", status.alias("s")).groupBy("pair").agg(
        count(F.col("s") == "PASS", "n_pass"), count(F.col("s") == "FAIL", "n_fail"), count(F.col("s") == "NOT_RUN", "n_not_run"),
        count(~F.col("s").isin("PASS", "FAIL", "NOT_RUN"), "n_unknown"),
    )
    out = pairs.join(run, "pair", "left").na.fill(0, ["n_pass", "n_fail", "n_not_run", "n_unknown"])
    rules = {
        "DEPENDENCY_FILES": (F.col("n_matches") > 0, 20), "ENDPOINT": (F.col("endpoint_changed"), 25), "DATABASE": (F.col("db_changed"), 20), "MEMBERS": (F.col("members_changed"), 15),
        "FAILED_TESTS": (F.col("n_fail") > 0, 40), "NO_RESULTS": ((F.col("n_not_run") + F.col("n_unknown") > 0) | (F.col("n_pass") + F.col("n_fail") == 0), 20),
    }
    return versions.risk(out, rules, F.coalesce("complete", F.lit(False)))


def by_relevance(candidates: DataFrame) -> DataFrame:
    """candidates(change, ticket, n_matches) with their rank in each change: most matches first, then the ticket."""
    return best_per(candidates, "change", [F.desc("n_matches"), F.col("ticket")], None)


def by_reach(uses: DataFrame) -> DataFrame:
    """(change, symbol, n_scenarios, n_endpoints, rank) of uses(change, symbol, scenario, endpoint): most scenarios first, then endpoints, then the name."""
    counted = uses.groupBy("change", "symbol").agg(F.countDistinct("scenario").alias("n_scenarios"), F.countDistinct("endpoint").alias("n_endpoints"))
    return best_per(counted, "change", [F.desc("n_scenarios"), F.desc("n_endpoints"), F.col("symbol")], None)


def what_if(requirements: DataFrame, evidence: DataFrame, derived: dict[str, list[str]]) -> DataFrame:
    """(requirement, field, kind, n_files): fields that a requirement names.

    requirements(requirement, text), evidence(field, file; file null: the field is known, no syntax was found). EXISTING_FIELD_IMPACT with the number of
    files that show it; fields without a file are not listed. PROPOSED_DERIVED_ATTRIBUTE where the text names a derived field and all it depends on
    (of which evidence knows); n_files 0 says that the source does not have it. Case does not matter; names meet whole words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    known = evidence.select(F.lower("field").alias("field"), "file").where("field is not null").groupBy("field").agg(F.countDistinct("file").alias("n_files"))
    wanted = known.select("field").unionByName(requirements.sparkSession.createDataFrame([(n.lower(),) for n in derived], "field string")).distinct()
    # words that name no field leave no task
    said = with_few(requirements.select("requirement", F.explode(words).alias("field")), wanted, "field", how="left_semi").distinct()
    named = said.join(known, "field")
    out = named.where("n_files > 0").select("requirement", "field", F.lit("EXISTING_FIELD_IMPACT").alias("kind"), "n_files")
    for name, parts in derived.items():
        parts = sorted({p.lower() for p in parts})
        whole = named.where(F.col("field").isin(parts)).groupBy("requirement").agg(F.count("*").alias("n")).where(F.col("n") == len(parts))
        asked = said.where(F.col("field") == name.lower()).join(whole.select("requirement"), "requirement").join(known, "field", "left")
        out = out.unionByName(asked.select("requirement", "field", F.lit("PROPOSED_DERIVED_ATTRIBUTE").alias("kind"), F.coalesce("n_files", F.lit(0)).alias("n_files")))
    return out


def file_scores(requirements: DataFrame, concepts: DataFrame, files: DataFrame, hits: DataFrame) -> DataFrame:
    """(requirement, path, n_class, n_source, n_methods, n_hits, concept, score): files that share words with a requirement, or that retrieval found.

    requirements(requirement, text), concepts(requirement, concept), files(path, class_name, methods, content), hits(requirement, path; each row counts).
    Words are runs of three letters or more, camelCase opened, of the requirement and its concepts. Fixed values: class name 6 + n; source n, at most 6;
    methods that share a word 2 each, at most 4; hits 3 + n, at most 8; 4 if a concept is the class's name."""
    asked = requirements.select("requirement", "text").unionByName(concepts.select("requirement", F.col("concept").alias("text")))
    words = asked.select("requirement", F.explode(letters(F.col("text"))).alias("w")).distinct()
    # the words of a file are a set of its row, so a pair's matches are counted where the file lies and leave the task as one row of sums
    own = lambda part, text: F.transform(letters(F.col(text)), lambda w: F.struct(F.lit(part).alias("part"), w.alias("w")))
    of_files = files.select("path", F.explode(F.concat(own("n_class", "class_name"), own("n_source", "content"))).alias("_s")).select("path", "_s.part", "_s.w")
    if not files.groupBy("path").count().where("count > 1").isEmpty():
        of_files = of_files.distinct()
    met = words.join(of_files, "w").select("requirement", "path", "part")
    methods = files.select("path", F.explode("methods").alias("item")).select("path", "item", F.explode(letters(F.col("item"))).alias("w"))
    shared = words.join(methods, "w").select("requirement", "path", "item").distinct().select("requirement", "path", F.lit("n_methods").alias("part"))
    found = hits.select("requirement", "path", F.lit("n_hits").alias("part"))
    same = concepts.select("requirement", compact(F.col("concept")).alias("c")).where("c <> ''").join(files.select("path", compact(F.col("class_name")).alias("c")), "c")
    same = same.select("requirement", "path", F.lit("concept").alias("part"))
    n = lambda part: F.count_if(F.col("part") == part)
    names = ["n_class", "n_source", "n_methods", "n_hits"]
    every = reduce(DataFrame.unionByName, [met, shared, found, same])
    out = every.groupBy("requirement", "path").agg(*[n(p).alias(p) for p in names], (n("concept") > 0).alias("concept"))
    score = (
        F.when(F.col("n_class") > 0, 6 + F.col("n_class")).otherwise(0) + F.least("n_source", F.lit(6)) + F.least(2 * F.col("n_methods"), F.lit(4))
        + F.when(F.col("n_hits") > 0, F.least(3 + F.col("n_hits"), F.lit(8))).otherwise(0) + F.when(F.col("concept"), 4).otherwise(0)
    )
    return out.withColumn("score", score)


def evaluation_cases(tests: DataFrame, question: str, absent: list[str]) -> DataFrame:
    """(case_type, query, ticket, test, scenario): one positive case for each test and ticket, and one negative for each question about what is known to be absent.

    tests(scenario, test, tickets). question has one %s for the test. Cases that differ in case only are one, of the least scenario and spelling."""
    each = tests.select("scenario", F.trim("test").alias("test"), F.explode("tickets").alias("ticket")).select("scenario", "test", F.upper(F.trim("ticket")).alias("ticket"))
    each = each.where("test <> '' and ticket <> ''").groupBy(F.lower("test").alias("_k"), "ticket").agg(F.min(F.struct("scenario", "test")).alias("m"))
    positive = each.select(F.lit("POSITIVE").alias("case_type"), F.format_string(question, "m.test").alias("query"), "ticket", "m.test", "m.scenario")
    nothing = tests.sparkSession.createDataFrame([(q,) for q in sorted(set(absent))], "query string")
    none = lambda c: F.lit(None).cast(positive.schema[c].dataType).alias(c)
    return positive.unionByName(nothing.select(F.lit("NEGATIVE").alias("case_type"), "query", none("ticket"), none("test"), none("scenario")))


def evaluation_summary(cases: DataFrame, results: DataFrame, by: list[str], k: int = 8) -> DataFrame:
    """by, n_cases, n_passed, precision, recall, mrr (means to four places) and n_noise of cases(case, case_type, by) with results(case, rank, relevant).

    A positive case passes if one of its first k results is relevant, a negative one if it has none; recall and mrr are means over positive cases
    (0 without any). Each positive case expects one piece of evidence."""
    first = results.where(F.col("rank") <= k).groupBy("case").agg(F.count("*").alias("n"), F.count_if("relevant").alias("good"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    one = cases.join(first, "case", "left").na.fill(0, ["n", "good"])
    positive = F.col("case_type") == "POSITIVE"
    precision = F.when(positive, F.when(F.col("n") > 0, F.round(F.col("good") / F.col("n"), 4)).otherwise(0.0)).otherwise(F.when(F.col("n") == 0, 1.0).otherwise(0.0))

    def mean(value: Column) -> Column:
        """The mean of values of four places, in whole numbers, so that ties round up in any order of rows."""
        total, n = F.sum(F.round(value * 10000).cast("long")), F.count(value)
        return F.coalesce(F.floor((2 * total + n) / (2 * n)) / 10000, F.lit(0.0))

    return one.groupBy(*by).agg(
        F.count("*").alias("n_cases"), F.count_if(F.when(positive, F.col("good") > 0).otherwise(F.col("n") == 0)).alias("n_passed"), mean(precision).alias("precision"),
        mean(F.when(positive, F.when(F.col("good") > 0, 1.0).otherwise(0.0))).alias("recall"), mean(F.when(positive, F.coalesce(F.round(1 / F.col("first"), 4), F.lit(0.0)))).alias("mrr"),
        F.sum(F.when(positive, F.col("n") - F.col("good")).otherwise(F.col("n"))).alias("n_noise"),
    )


def reconciled(documents: DataFrame, project: str) -> DataFrame:
    """documents of one project, in any spelling, with the project as written here and what changed.

    documents(document, project, filename, family, version, status, source_ref, checksum, n_rows). A version in the file name sets family and version;
    without one only an empty family is filled. Of ACTIVE rows with one source and checksum the newest that has rows stays, the others are DUPLICATE."""
    canonical = project.strip().replace("/", "\\").rstrip("\\")
    mine = documents.where(scope_key(F.col("project")) == scope_key(F.lit(project))).withColumn("_i", family_and_version(F.col("filename")))
    stated, blank = F.col("_i.version").isNotNull(), F.coalesce(F.trim("family"), F.lit("")) == ""
    fixed = F.when(stated, ~F.col("family").eqNullSafe(F.col("_i.family")) | ~F.col("version").eqNullSafe(F.col("_i.version"))).otherwise(blank)
    source = F.lower(F.replace(F.coalesce(F.nullif("source_ref", F.lit("")), "filename"), F.lit("/"), F.lit("\\")))
    mine = mine.select(
        "document", F.when(stated | blank, F.col("_i.family")).otherwise(F.col("family")).alias("family"), F.when(stated, F.col("_i.version")).otherwise(F.col("version")).alias("version"),
        "status", fixed.alias("metadata_fixed"), (F.col("project") != canonical).alias("project_fixed"), source.alias("_s"), F.col("checksum").alias("_c"), (F.coalesce("n_rows", F.lit(0)) > 0).alias("_r"),
    )
    newest = mine.where("status = 'ACTIVE'").groupBy("_s", "_c").agg(F.max(F.struct("_r", "document"))["document"].alias("_best"))
    out = mine.join(newest, (mine["_s"] == newest["_s"]) & mine["_c"].eqNullSafe(newest["_c"]), "left")
    status = F.when((F.col("status") == "ACTIVE") & (F.col("document") != F.col("_best")), "DUPLICATE").otherwise(F.col("status"))
    return out.select("document", F.lit(canonical).alias("project"), "family", "version", status.alias("status"), "metadata_fixed", "project_fixed")


def _methods_of(tree: str | None, depth: int | None) -> list[str]:
    """Distinct Class.method of one call tree in the order of a walk."""
    try:
        root = json.loads(tree, object_pairs_hook=_once, parse_constant=_once) if tree else None
    except ValueError:
        return []
    at: dict[tuple[int, ...], list[str]] = {}  # names by the places of the calls that lead to them
    todo = [((), root, 1)] + ([((), root.get("flow"), 2)] if isinstance(root, dict) else [])
    while todo:
        place, node, step = todo.pop()
        if isinstance(node, dict) and (depth is None or step <= depth):
            names = at.setdefault(place, ["", ""])
            for i, which in enumerate(("class_name", "method_name")):
                if isinstance(node.get(which), str):
                    names[i] = max(names[i], node[which])
            calls = node.get("calls")
            todo += [((*place, i), c, step + 2) for i, c in enumerate(calls if isinstance(calls, list) else [])]
    return list(dict.fromkeys(f"{c}.{m}" for _, (c, m) in sorted(at.items()) if c and m))


def _once(pairs: list | str) -> dict:
    """An object whose keys differ; NaN and the like are no JSON."""
    if isinstance(pairs, str) or len(out := dict(pairs)) < len(pairs):
        raise ValueError(pairs)
    return out


def flow_methods(flows: DataFrame, flow: str, tree: str, depth: int | None = None) -> DataFrame:
    """(flow, methods): distinct Class.method of a call tree in the order of a walk from the root; flows without any are left out.

    tree is JSON: class_name, method_name and calls, a list of such nodes, as a whole or under "flow"; names are texts that are not empty. One row for each flow; a tree is walked where
    it lies, in one pass, and meets no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            methods = pa.array([_methods_of(t, depth) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), methods], [flow, "methods"])

    kind = flows.schema[flow].dataType.simpleString()
    return flows.select(flow, F.col(tree).cast("string").alias("_tree")).mapInArrow(run, f"`{flow}` {kind}, methods array<string>").where("size(methods) > 0")


def operation_role(verb: Column, targets: Column) -> Column:
    """struct(roles, priority) of an operation for a requirement by its verb; targets: its path or method names the attribute. A role, no verified change."""
    v = F.upper(F.coalesce(verb, F.lit("")))
    role = lambda priority, *roles: F.struct(F.array(*map(F.lit, roles)).alias("roles"), F.lit(priority).alias("priority"))
    return (
        F.when(v.isin("POST", "PUT") | ((v == "PATCH") & targets), role("HIGH", "INPUT", "PERSISTENCE")).when(v == "GET", role("MEDIUM", "OUTPUT"))
        .when(v == "PATCH", role("LOW", "INDIRECT_REGRESSION")).when(v == "DELETE", role("LOW", "LIFECYCLE_REGRESSION")).otherwise(role("REVIEW", "UNDETERMINED"))
    )


def change_scope(verb: Column, targets: Column, n_changed: Column, n_output: Column, unresolved: Column) -> Column:
    """What is proposed for an operation: n_changed attributes change, n_output of them in what is read. Requirement intent, never verified."""
    v = F.upper(F.coalesce(verb, F.lit("")))
    proposed, unrelated = F.lit("PROPOSED_IMPLEMENTATION"), F.lit("REGRESSION_ONLY_OR_UNRELATED")
    return (
        F.when(unresolved, "PROVISIONAL_PENDING_CLARIFICATION").when((n_changed == 0) | (v == "DELETE"), unrelated)
        .when(v == "GET", F.when(n_output > 0, proposed).otherwise(unrelated)).when((v == "PATCH") & ~F.coalesce(targets, F.lit(False)), "INDIRECT_REGRESSION")
        .when(v.isin("POST", "PUT", "PATCH"), proposed).otherwise("REVIEW_ONLY")
    )


def refreshed(changed: DataFrame, declared: DataFrame, lines: DataFrame, corpus: DataFrame, scanned: DataFrame) -> DataFrame:
    """(field, n_files, n_lines): evidence of the fields that changed files declare, over the whole corpus.

    changed(path), declared(path, field), lines(field, path, line), corpus(path), scanned(path). A file of the corpus that was not scanned is an error, so
    that a revision is never marked complete on part of the evidence. Fields without a line have 0."""
    missing = corpus.select("path").join(scanned.select("path"), "path", "left_anti").limit(1).collect()  # one row for the message
    if missing:
        raise ValueError(f"the scan is incomplete: {missing[0][0]} was not read")
    fields = declared.join(changed.select("path").distinct(), "path", "left_semi").select("field").distinct()
    met = lines.select("field", "path", "line").distinct().groupBy("field").agg(F.countDistinct("path").alias("n_files"), F.count("*").alias("n_lines"))
    return fields.where("field is not null").join(met, "field", "left").na.fill(0, ["n_files", "n_lines"])


def symbol_lookup(requests: DataFrame, symbols: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(request, class_name, method, path, line, sha256): exact places of the class and method that a request names; nothing is ranked.

    requests(request, text), symbols(path, class_name, method, line, content). The class is the first identifier with a capital that ends in one of the
    roles; the method the first identifier before a bracket. Without a method the class's file is given once, with null line."""
    names = F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    owner = F.get(F.filter(names, lambda n: n.rlike(f"^[A-Z].*({'|'.join(roles)})$")), F.lit(0))
    called = F.nullif(F.regexp_extract("text", r"([a-z][A-Za-z0-9_]*)\s*\(", 1), F.lit(""))
    asked = requests.select("request", owner.alias("class_name"), called.alias("wanted")).where("class_name is not null")
    at = symbols.select("path", "class_name", "method", "line", F.sha2("content", 256).alias("sha256"))
    met = asked.join(at, "class_name").where("wanted is null or wanted = method")
    once = lambda c: F.when(F.col("wanted").isNotNull(), F.col(c)).alias(c)
    return met.select("request", "class_name", once("method"), "path", once("line"), "sha256").distinct()


def attribute_impact(attributes: DataFrame, evidence: dict[str, DataFrame]) -> DataFrame:
    """attribute with the number of distinct items of every kind, evidence[kind](attribute, item), and status: EVIDENCE_FOUND or NO_EVIDENCE.

    Attributes meet case and separators aside; one in several spellings is listed in its least."""
    asked = attributes.select(compact(F.col("attribute")).alias("_k"), "attribute").where("_k <> ''").groupBy("_k").agg(F.min("attribute").alias("attribute"))
    long = reduce(DataFrame.unionByName, [df.select(compact(F.col("attribute")).alias("_k"), F.lit(kind).alias("kind"), F.col("item").cast("string").alias("item")) for kind, df in evidence.items()])
    counted = long.where("item is not null").distinct().groupBy("_k").agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in evidence])
    out = asked.join(counted, "_k", "left").drop("_k").na.fill(0, list(evidence))
    found = reduce(lambda a, b: a + b, [F.col(kind) for kind in evidence])
    return out.withColumn("status", F.when(found > 0, "EVIDENCE_FOUND").otherwise("NO_EVIDENCE"))

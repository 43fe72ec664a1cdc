"""Versions, releases and test evidence of scenarios: sequences, relative versions, overviews, closure.

All frames are plain tables; every choice among rows is a total order, so reruns agree. Nulls in keys are keys of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_sequences(existing: DataFrame, incoming: DataFrame, scenario: str, release: str, *order: str) -> DataFrame:
    """incoming with `version`, counted on per scenario, and `release_version`, per scenario and release, after those of existing."""
    own = F.row_number().over(Window.partitionBy(scenario).orderBy(*order))
    within = F.row_number().over(Window.partitionBy(scenario, release).orderBy(*order))
    last = existing.groupBy(scenario).agg(F.max("version").alias("_v"))
    last_in = existing.groupBy(scenario, release).agg(F.max("release_version").alias("_r"))
    numbered = incoming.withColumns({"_own": own, "_within": within}).join(last, scenario, "left").join(last_in, [scenario, release], "left")
    return numbered.select(*incoming.columns, (F.coalesce("_v", F.lit(0)) + F.col("_own")).alias("version"), (F.coalesce("_r", F.lit(0)) + F.col("_within")).alias("release_version"))


def activated(versions: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """versions with `is_active`: only the newest of each key is."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), *[F.desc(t) for t in ties]))
    return versions.withColumn("is_active", newest == 1)


def latest_two(captured: DataFrame, operation: str, version: str, fingerprint: str) -> DataFrame:
    """operation, new_version, old_version and status: INSUFFICIENT with fewer than two distinct versions, else CHANGED or UNCHANGED.

    Of rows with one version the greatest fingerprint counts."""
    distinct = captured.groupBy(operation, version).agg(F.max(fingerprint).alias("print"))
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy(operation).orderBy(F.desc(version)))).where("r <= 2")
    at = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    both = ranked.groupBy(operation).agg(at(1, version).alias("new_version"), at(2, version).alias("old_version"), at(1, "print").alias("a"), at(2, "print").alias("b"))
    status = F.when(F.col("old_version").isNull(), "INSUFFICIENT").when(F.col("a").eqNullSafe(F.col("b")), "UNCHANGED").otherwise("CHANGED")
    return both.select(operation, "new_version", "old_version", status.alias("status"))


def relative_version(documents: DataFrame, requests: DataFrame, attribute: str, family: str, version: Column, back: int) -> DataFrame:
    """For each requested attribute the version `back` steps before the latest (0: the latest) of the family with strictly most documents.

    status: FOUND, AMBIGUOUS (families tie), NOT_FOUND (no document, or not so many versions)."""
    named = documents.select(attribute, F.col(family).alias("family"), version.alias("version"))
    sizes = named.groupBy(attribute, "family").agg(F.count("*").alias("n"))
    top = sizes.groupBy(attribute).agg(F.max("n").alias("n"))
    best = sizes.join(top, [attribute, "n"]).groupBy(attribute).agg(F.count("*").alias("ties"), F.min("family").alias("family"))
    versions = named.select(attribute, "family", "version").distinct()
    step = F.row_number().over(Window.partitionBy(attribute, "family").orderBy(F.desc("version")))
    picked = versions.withColumn("step", step).where(F.col("step") == back + 1).drop("step")
    out = requests.select(attribute).distinct().join(best, attribute, "left").join(picked, [attribute, "family"], "left")
    single = F.col("ties") == 1
    status = F.when(F.col("ties") > 1, "AMBIGUOUS").when(single & F.col("version").isNotNull(), "FOUND").otherwise("NOT_FOUND")
    return out.select(attribute, F.when(single, F.col("family")).alias("family"), F.when(single, F.col("version")).alias("version"), status.alias("status"))


def latest_mention(candidates: DataFrame, attribute: str, ticket: str, created: str) -> DataFrame:
    """The ticket that mentions an attribute last, said only if all its candidates have a date; of equal dates the greatest ticket."""
    out = candidates.groupBy(attribute).agg(F.max(F.struct(created, ticket)).alias("last"), F.count_if(F.col(created).isNull()).alias("undated"), F.count("*").alias("n_candidates"))
    known = F.col("undated") == 0
    return out.select(attribute, F.when(known, F.col("last")[ticket]).alias("ticket"), "n_candidates", F.when(known, "LATEST").otherwise("RECENCY_NOT_VERIFIED").alias("status"))


def family_rollup(documents: DataFrame, family: str, version: str, order: Column) -> DataFrame:
    """One row per family: its distinct versions in order, the latest, and its documents."""
    each = documents.groupBy(family).agg(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct(order.alias("o"), F.col(version).alias("v")))), lambda x: x["v"])).alias("versions"), F.count("*").alias("n_documents"))
    return each.withColumn("latest", F.element_at("versions", -1))


def pivoted(rows: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """One row per key with a count for each status value, n_<value>."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values], F.count("*").alias("n"))


def scenario_overview(scenarios: DataFrame, baselines: DataFrame, tests: DataFrame, key: str) -> DataFrame:
    """scenarios with their active version (null: none), versions in history, and distinct tests. baselines(key, version), tests(key, test_id)."""
    history = baselines.groupBy(key).agg(F.max("version").alias("active_version"), F.countDistinct("version").alias("n_versions"))
    tested = tests.groupBy(key).agg(F.countDistinct("test_id").alias("n_tests"))
    out = scenarios.join(history, key, "left").join(tested, key, "left")
    return out.withColumns({"n_versions": F.coalesce("n_versions", F.lit(0)), "n_tests": F.coalesce("n_tests", F.lit(0))})


def operation_overview(scenarios: DataFrame, captured: DataFrame, current: DataFrame, operation: list[str]) -> DataFrame:
    """One row per operation: its scenarios, and NO_BASELINE, UNCHANGED or CODE_CHANGED by the fingerprints of captured and current."""
    counts = scenarios.groupBy(*operation).agg(F.count("*").alias("n_scenarios"))
    was, now = (df.select(*operation, F.col("fingerprint").alias(name)) for df, name in ((captured, "was"), (current, "now")))
    out = counts.join(was, operation, "left").join(now, operation, "left")
    status = F.when(F.col("was").isNull(), "NO_BASELINE").when(F.col("was").eqNullSafe(F.col("now")), "UNCHANGED").otherwise("CODE_CHANGED")
    return out.select(*operation, "n_scenarios", status.alias("change_status"))


def combined_fingerprint(code: DataFrame, flow: DataFrame, keys: list[str]) -> DataFrame:
    """keys and one digest of their code's and their flow's; a missing one counts as the empty text."""
    both = code.select(*keys, F.col("fingerprint").alias("code")).join(flow.select(*keys, F.col("fingerprint").alias("flow")), keys, "full_outer")
    part = lambda c: F.coalesce(c, F.lit(""))
    return both.select(*keys, F.sha2(F.concat(F.lit("code:"), part("code"), F.lit("\nflow:"), part("flow")), 256).alias("fingerprint"))


def release_summary(items: DataFrame, release: str) -> DataFrame:
    """Counts of a release's items(release, ticket, covered, status, basis): covered, gaps, failed, linked (explicit) and inferred tickets."""
    tickets = items.groupBy(release, "ticket").agg(F.bool_or("covered").alias("covered"), F.bool_or(F.col("status") == "FAILED").alias("failed"), F.bool_or(F.col("basis") == "EXPLICIT").alias("linked"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return tickets.groupBy(release).agg(
        F.count("*").alias("n_tickets"), count(F.col("covered")).alias("n_covered"), F.count_if(~F.coalesce("covered", F.lit(False))).alias("n_gaps"),
        count(F.col("failed")).alias("n_failed"), count(F.col("linked")).alias("n_linked"), F.count_if(~F.coalesce("linked", F.lit(False))).alias("n_inferred"),
    )


def endpoint_evidence(evidence: DataFrame, endpoint: str, ticket: str, test: str) -> DataFrame:
    """One row per endpoint: its distinct (ticket, test) pairs in order, and how many tickets and tests they name."""
    pairs = evidence.select(endpoint, ticket, test).distinct()
    return pairs.groupBy(endpoint).agg(F.array_sort(F.collect_list(F.struct(ticket, test))).alias("evidence"), F.countDistinct(ticket).alias("n_tickets"), F.countDistinct(test).alias("n_tests"))


def report_totals(cases: DataFrame, report: str, class_name: str, status: str) -> DataFrame:
    """Totals of test reports: cases, passed, failed, skipped, distinct classes, and the report's own status."""
    count = lambda s: F.count_if(F.col(status) == s)
    out = cases.groupBy(report).agg(F.count("*").alias("n"), count("PASSED").alias("n_passed"), count("FAILED").alias("n_failed"), count("SKIPPED").alias("n_skipped"), F.countDistinct(class_name).alias("n_classes"))
    return out.withColumn("status", F.when(F.col("n_failed") > 0, "FAILED").when(F.col("n_passed") == F.col("n"), "PASSED").otherwise("PARTIAL"))


def test_summary_changes(tests: DataFrame, key: str, side: Column) -> DataFrame:
    """For each key the tests, tickets and statuses of the old (side false) and new tests, as sorted distinct sets, and which of them differ."""
    sides = tests.withColumn("_new", side).groupBy(key, "_new").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in ("test_id", "ticket", "status")])
    a, b = (sides.where(F.col("_new") == new).select(key, F.struct("test_id", "ticket", "status").alias(name)) for new, name in ((False, "old"), (True, "new")))
    both = a.join(b, key, "full_outer")
    differ = lambda c: ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    out = both.withColumns({"tests_changed": differ("test_id"), "tickets_changed": differ("ticket"), "statuses_changed": differ("status")})
    return out.withColumn("changed", F.col("tests_changed") | F.col("tickets_changed") | F.col("statuses_changed"))


def lifecycle(scenarios: DataFrame, baselines: DataFrame, runs: DataFrame, key: str, ticket: str) -> DataFrame:
    """Closure of affected scenarios(key, ticket): their baselines split into those of the ticket and historical ones, gap codes, runtime status.

    baselines(key, ticket, kind: TEST or RELEASE), runs(key, status). runtime: FAIL if any run failed, PASS if all passed, PARTIAL if some
    did, else NOT_RUN. overall: TRACEABILITY_COMPLETE without a gap, else ACTION_REQUIRED."""
    own = baselines.withColumnRenamed(ticket, "_of")
    joined = scenarios.join(own, key, "left").groupBy(key, ticket).agg(
        F.count_if((F.col("kind") == "TEST") & (F.col("_of") == F.col(ticket))).alias("n_current_tests"), F.count_if((F.col("kind") == "TEST") & (F.col("_of") != F.col(ticket))).alias("n_historical_tests"),
        F.count_if((F.col("kind") == "RELEASE") & (F.col("_of") == F.col(ticket))).alias("n_current_releases"), F.count_if((F.col("kind") == "RELEASE") & (F.col("_of") != F.col(ticket))).alias("n_historical_releases"),
    )
    ran = runs.groupBy(key).agg(F.bool_or(F.col("status") == "FAILED").alias("failed"), F.bool_and(F.col("status") == "PASSED").alias("all"), F.bool_or(F.col("status") == "PASSED").alias("some"))
    out = joined.join(ran, key, "left")
    runtime = F.when(F.col("failed"), "FAIL").when(F.col("all"), "PASS").when(F.col("some"), "PARTIAL").otherwise("NOT_RUN")
    gaps = F.array_compact(F.array(F.when(F.col("n_current_tests") == 0, "NO_CAPTURED_TEST_BASELINE"), F.when(F.col("n_current_releases") == 0, "NO_RELEASE_BASELINE"), F.when(runtime != "PASS", "RUNTIME_NOT_PASSED")))
    out = out.withColumns({"runtime": runtime, "gaps": gaps}).drop("failed", "all", "some")
    return out.withColumn("overall", F.when(F.size("gaps") == 0, "TRACEABILITY_COMPLETE").otherwise("ACTION_REQUIRED"))


def pair_compare(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per baseline pair: for each part, a frame (keys, item, old, new) of items compared, how many were added, removed and
    changed; and `changed`, whether any was."""
    every = None
    for name, df in parts.items():
        one = df.select(*keys, F.lit(name).alias("part"), "old", "new")
        every = one if every is None else every.unionByName(one)
    added, removed = F.col("old").isNull() & F.col("new").isNotNull(), F.col("old").isNotNull() & F.col("new").isNull()
    counts = []
    for name in parts:
        of = F.col("part") == name
        counts += [F.count_if(of & added).alias(f"{name}_added"), F.count_if(of & removed).alias(f"{name}_removed"), F.count_if(of & F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))).alias(f"{name}_changed")]
    return every.groupBy(*keys).agg(*counts, F.bool_or(~F.col("old").eqNullSafe(F.col("new"))).alias("changed"))


def relevant_files(files: DataFrame, involved: DataFrame, key: str) -> DataFrame:
    """files(path, ...) with the keys of scenarios whose involved classes they hold: the file's name without its folder and extension is the class. involved(key, class_name)."""
    stem = F.regexp_replace(F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return files.withColumn("class_name", stem).join(involved.select(key, "class_name").distinct(), "class_name").drop("class_name")


def archived(rows: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    """keys, the rows of each as one JSON text in order, and its digest; `verified` of an archive recomputes it."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*items))))
    return rows.groupBy(*keys).agg(body.alias("archive")).withColumn("archive_sha256", F.sha2("archive", 256))


def verified(archive: DataFrame) -> DataFrame:
    """archive with `intact`: whether the digest is that of the text."""
    return archive.withColumn("intact", F.sha2("archive", 256).eqNullSafe(F.col("archive_sha256")))


def source_verification(sources: DataFrame, runs: DataFrame, records: DataFrame, source: str) -> DataFrame:
    """sources with their latest run, records, how many of these are indexed and how many out of scope; VERIFIED if the last run
    succeeded and all records are indexed in scope, NOT_VERIFIED without a run or record, else PARTIAL.

    runs(source, run_id, status), records(source, indexed, in_scope)."""
    last = runs.groupBy(source).agg(F.max(F.struct("run_id", "status"))["status"].alias("last_status"))
    counts = records.groupBy(source).agg(F.count("*").alias("n_records"), F.count_if("indexed").alias("n_indexed"), F.count_if(~F.col("in_scope")).alias("n_out_of_scope"))
    out = sources.join(last, source, "left").join(counts, source, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_records", "n_indexed", "n_out_of_scope")})
    whole = (F.col("last_status") == "SUCCESS") & (F.col("n_records") == F.col("n_indexed")) & (F.col("n_out_of_scope") == 0)
    return out.withColumn("verification", F.when(F.col("last_status").isNull() | (F.col("n_records") == 0), "NOT_VERIFIED").when(whole, "VERIFIED").otherwise("PARTIAL"))


def registered(known: DataFrame, discovered: DataFrame, operation: list[str], code: Column) -> DataFrame:
    """Operations of discovered that known lacks, once each, with a code of their own: the first of a code takes it as it is if no known
    operation has it, the others get a counter. known(operation, code)."""
    new = discovered.select(*operation).distinct().join(known.select(*operation), operation, "left_anti").withColumn("stem", code)
    used = known.select(F.col("code").alias("stem")).distinct().withColumn("_used", F.lit(1))
    at = F.row_number().over(Window.partitionBy("stem").orderBy(*operation))
    out = new.withColumn("_at", at).join(used, "stem", "left")
    number = F.col("_at") + F.coalesce("_used", F.lit(0))
    return out.select(*operation, F.when(number == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), number.cast("string"))).alias("code"))


def gaps_left(gaps: DataFrame, captured: DataFrame, key: str, kind: str = "NO_CAPTURED_TEST_BASELINE") -> DataFrame:
    """gaps(key, gap) with `removed`: gaps of one kind whose key has a captured baseline go; all other gaps stay."""
    have = captured.select(key).distinct().withColumn("_have", F.lit(True))
    return gaps.join(have, key, "left").withColumn("removed", (F.col("gap") == kind) & F.coalesce("_have", F.lit(False))).drop("_have")


def authoritative_links(links: dict[str, DataFrame], change: str, ticket: str) -> DataFrame:
    """Union of explicit links by kind of evidence: change, ticket, and the sorted kinds that link them."""
    every = None
    for kind, df in links.items():
        one = df.select(change, ticket, F.lit(kind).alias("kind")).where(F.col(ticket).isNotNull())
        every = one if every is None else every.unionByName(one)
    return every.groupBy(change, ticket).agg(F.array_sort(F.collect_set("kind")).alias("evidence"))

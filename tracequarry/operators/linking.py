"""Joins of tests, endpoints, changes, tickets and documents by what they share. Explicit beats overlap; overlaps are said to be such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.text import compact, endpoint_key


def endpoint_matches(scenarios: DataFrame, endpoints: DataFrame, scenario: str = "scenario", path: str = "path", endpoint: str = "endpoint") -> DataFrame:
    """(scenario, endpoint, basis): EXACT by the canonical path, else UNIQUE_SUFFIX if just one endpoint ends with the scenario's path or begins
    its end. Both sides are opened into the suffixes of their segments, so suffixes meet by equality."""
    a = scenarios.select(scenario, endpoint_key(F.col(path)).alias("_k")).where("_k <> ''").distinct()
    b = endpoints.select(endpoint, endpoint_key(F.col(endpoint)).alias("_k")).where("_k <> ''").distinct()
    exact = a.join(b, "_k").select(scenario, endpoint, F.lit("EXACT").alias("basis"))
    left = a.join(exact.select(scenario).distinct(), scenario, "left_anti")
    parts = F.filter(F.split("_k", "/"), lambda x: x != "")
    tail = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    suffixes = b.where(F.size(parts) > 0).select(endpoint, F.explode(tail).alias("_s"))
    met = left.withColumn("_s", F.array_join(parts, "/")).where("_s <> ''").join(suffixes, "_s").groupBy(scenario).agg(F.count("*").alias("n"), F.min(endpoint).alias(endpoint))
    return exact.unionByName(met.where("n = 1").select(scenario, endpoint, F.lit("UNIQUE_SUFFIX").alias("basis")))


def overlapping_tests(tests: DataFrame, scenarios: DataFrame, first: int = 30) -> DataFrame:
    """(scenario, test, n_calls, n_attributes, basis, rank): tests that share a call and an attribute with a scenario, at most `first` for each.

    tests(test, calls, attributes), scenarios(scenario, calls, attributes, entry), one row for each. basis: DIRECT if the test calls the entry, TRANSITIVE if it
    shares calls of two or more, else SHARED. Pairs come from shared calls alone; attributes, of which there may be few in all, are
    intersected in the rows of these pairs, so that they make no pairs of their own."""
    named = lambda df, key: df.select(key, F.explode(F.array_distinct("calls")).alias("x"))
    pairs = named(tests, "test").join(named(scenarios, "scenario"), "x").groupBy("scenario", "test").agg(F.count("*").alias("n_calls"))
    of_scenario = scenarios.select("scenario", "entry", F.array_compact(F.array_distinct("attributes")).alias("_s"))
    of_test = tests.select("test", F.col("calls").alias("_c"), F.array_compact(F.array_distinct("attributes")).alias("_t"))
    out = pairs.join(of_scenario, "scenario").join(of_test, "test").withColumn("n_attributes", F.size(F.array_intersect("_s", "_t")).cast("long")).where("n_attributes > 0")
    out = out.withColumn("_d", F.coalesce(F.array_contains("_c", F.col("entry")), F.lit(False)))
    basis = F.when(F.col("_d"), "DIRECT").when(F.col("n_calls") >= 2, "TRANSITIVE").otherwise("SHARED")
    order = F.when(F.col("_d"), 0).when(F.col("n_calls") >= 2, 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("scenario").orderBy(order, F.desc(F.col("n_calls") + F.col("n_attributes")), "test"))
    return out.select("scenario", "test", "n_calls", "n_attributes", basis.alias("basis"), rank.alias("rank")).where(F.col("rank") <= first)


def sharing_entities(seeds: DataFrame, documents: DataFrame, seed: str, document: str, entity: str = "entity") -> DataFrame:
    """(seed, document, n_shared): documents that share an entity with a seed, itself left out. Both frames have one row per entity."""
    a, b = seeds.select(seed, entity).distinct(), documents.select(document, entity).distinct()
    return a.join(b, entity).where(F.col(seed) != F.col(document)).groupBy(seed, document).agg(F.count("*").alias("n_shared"))


def expanded(mentions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, entity, n_documents): other entities of the documents that mention a seed entity. mentions(document, entity), seeds(entity)."""
    m = mentions.select("document", "entity").distinct()
    via = m.join(seeds.select(F.col("entity").alias("seed")).distinct(), F.col("entity") == F.col("seed")).select("document", "seed")
    return via.join(m, "document").where("entity <> seed").groupBy("seed", "entity").agg(F.count("*").alias("n_documents"))


def trusted_links(links: DataFrame, tickets: DataFrame, types: list[str]) -> DataFrame:
    """Links that are verified, name their evidence and come from an allowed type of source, of tickets of the link's own scope."""
    good = links.where(F.col("verified") & F.col("evidence_id").isNotNull() & F.col("source_type").isin(types))
    return good.join(tickets.select("ticket", "scope"), ["ticket", "scope"], "left_semi")


def attribute_lines(lines: DataFrame, tickets: DataFrame, most: int = 40) -> DataFrame:
    """(ticket, path, line, attribute, score, rank): source lines that name an attribute of a ticket as an identifier.

    0.65, 0.15 more if the line reads or writes it by an accessor, 0.10 more if it stands outside comments; 0.90 at most. lines(path, line, text),
    tickets(ticket, attribute). Lines meet tickets on single identifiers; a line that names an attribute twice counts once, at its best."""
    words = lines.select("path", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("word"))
    bare = F.regexp_replace("word", "^(get|set|is)(?=[A-Z])", "")
    met = words.withColumn("_k", compact(bare)).join(tickets.select("ticket", "attribute", compact(F.col("attribute")).alias("_k")).distinct(), "_k")
    score = F.lit(0.65) + F.when(F.col("word").rlike("^(get|set|is)[A-Z]"), 0.15).otherwise(0.0) + F.when(~F.trim("text").rlike(r"^(//|\*|/\*)"), 0.10).otherwise(0.0)
    each = met.groupBy("ticket", "path", "line", "attribute").agg(F.max(F.round(F.least(F.lit(0.90), score), 2)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("ticket").orderBy(F.desc("score"), "path", "line", "attribute"))
    return each.withColumn("rank", rank).where(F.col("rank") <= most)


def test_operations(tests: DataFrame, operations: DataFrame) -> DataFrame:
    """(test, operation, basis) of tests(test, declared or null, scenario): CONFIRMED if the declared operation is an endpoint or method, a
    SUGGESTION if nothing is declared and the scenario names the operation's method as a whole word. operations(operation, endpoint, method)."""
    keys = operations.select("operation", F.explode(F.array(F.lower(endpoint_key(F.col("endpoint"))), F.lower("method"))).alias("_k")).where("_k is not null").distinct()
    confirmed = tests.where("trim(declared) <> ''").withColumn("_k", F.lower(endpoint_key(F.trim("declared")))).join(keys, "_k").select("test", "operation", F.lit("CONFIRMED").alias("basis")).distinct()
    words = tests.where("coalesce(trim(declared), '') = ''").select("test", F.explode(F.array_distinct(F.split(F.lower("scenario"), "[^a-z0-9_]+"))).alias("_k"))
    named = operations.select("operation", F.lower("method").alias("_k")).where("_k <> ''").distinct()
    return confirmed.unionByName(words.join(named, "_k").select("test", "operation", F.lit("SUGGESTION").alias("basis")).distinct())


def with_evidence(hits: DataFrame, evidence: DataFrame, path: str) -> DataFrame:
    """hits with n_evidence, how many rows of evidence their file has."""
    counts = evidence.groupBy(path).agg(F.count("*").alias("n_evidence"))
    return hits.join(counts, path, "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))


def runtime_status(methods: DataFrame, reports: DataFrame) -> DataFrame:
    """methods(test_class or null, test_method) with the status of the newest report of their class and method; either side may lack the class.

    reports(class_name, method, status, created, report_id). Class names count without packages, methods without arguments and indexes."""
    simple = lambda c: F.lower(F.substring_index(c, ".", -1))
    bare = lambda c: F.lower(F.regexp_replace(c, r"(\(.*\)|\[.*\])$", ""))
    r = reports.select(simple("class_name").alias("_rc"), bare("method").alias("_m"), F.struct("created", "report_id", "status").alias("run"))
    # the newest of each (class, method) first, so that a method meets as many rows as classes have it
    r = r.groupBy("_rc", "_m").agg(F.max("run").alias("run"))
    m = methods.select("test_class", "test_method").distinct().select("test_class", "test_method", simple("test_class").alias("_c"), bare("test_method").alias("_m"))
    met = m.join(r, "_m", "left").where(F.col("_rc").isNull() | F.col("_c").isNull() | (F.col("_c") == F.col("_rc")))
    best = met.groupBy("test_class", "test_method").agg(F.max("run").alias("run"))
    out = m.select("test_class", "test_method").alias("m").join(best.alias("b"), F.col("m.test_class").eqNullSafe(F.col("b.test_class")) & (F.col("m.test_method") == F.col("b.test_method")), "left")
    return out.select("m.test_class", "m.test_method", F.coalesce("b.run.status", F.lit("NO_RUNTIME_EVIDENCE")).alias("status"))


def class_scenarios(changes: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row per changed class with the sorted scenarios that it affects. scenarios(scenario, classes, methods, path_classes): by a class,
    by a method written Class.method, or by a class on a dependency path."""
    of_method = F.transform("methods", lambda m: F.substring_index(m, ".", 1))
    every = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    keys = scenarios.select("scenario", F.explode(F.array_distinct(F.concat(every(F.col("classes")), every(of_method), every(F.col("path_classes"))))).alias("class_name"))
    met = changes.select("class_name").distinct().join(keys, "class_name", "left").groupBy("class_name")
    return met.agg(F.array_sort(F.collect_set("scenario")).alias("scenarios"))


def project_endpoints(controllers: DataFrame, matched: DataFrame, references: DataFrame) -> DataFrame:
    """Endpoints of controller methods that call a matched method of their project, or whose class references the attribute.

    controllers(project, class_name, endpoint, calls), matched(project, method), references(project, class_name)."""
    called = controllers.select("project", "endpoint", F.explode("calls").alias("method")).join(matched.select("project", "method").distinct(), ["project", "method"], "left_semi").select("project", "endpoint")
    referenced = controllers.join(references.select("project", "class_name").distinct(), ["project", "class_name"], "left_semi").select("project", "endpoint")
    return called.unionByName(referenced).distinct()


def ticket_chain(mentions: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(attribute, ticket, n_commits, n_verified, status): tickets that mention an attribute, their commits by explicit key, and those of
    them that change that attribute; VERIFIED only if the last link holds, else EXAMINED. mentions(attribute, ticket), commits(sha, ticket), changes(sha, attribute)."""
    m = mentions.select("attribute", "ticket").distinct()
    hop = m.join(commits.select("sha", "ticket").distinct(), "ticket", "left")
    proof = changes.select("sha", "attribute").distinct().withColumn("_v", F.lit(True))
    out = hop.join(proof, ["sha", "attribute"], "left").groupBy("attribute", "ticket").agg(F.count("sha").alias("n_commits"), F.count("_v").alias("n_verified"))
    return out.withColumn("status", F.when(F.col("n_verified") > 0, "VERIFIED").otherwise("EXAMINED"))


def attribute_match(declared: Column, attribute: Column, text: Column) -> Column:
    """Whether a test case is about an attribute: its declared attribute decides if there is one, else a mention as a whole identifier in its text."""
    same = compact(F.substring_index(declared, ".", -1)) == compact(attribute)
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "), F.lit(" "))
    return F.when(F.coalesce(F.trim(declared), F.lit("")) != "", same).otherwise(F.coalesce(F.contains(padded, F.concat(F.lit(" "), F.lower(attribute), F.lit(" "))), F.lit(False)))


def test_role(attributes: Column, new: Column, protected: Column, changed: Column) -> Column:
    """The role of a test by the attributes it names: NEW_BEHAVIOUR, PROTECTED_BEHAVIOUR, CHANGED_ATTRIBUTE or RELATED, the first that fits."""
    return F.when(F.arrays_overlap(attributes, new), "NEW_BEHAVIOUR").when(F.arrays_overlap(attributes, protected), "PROTECTED_BEHAVIOUR").when(F.arrays_overlap(attributes, changed), "CHANGED_ATTRIBUTE").otherwise("RELATED")


#: Kinds of reach, the strongest first.
REACH = ("DIRECT", "TRANSITIVE", "SHARED")


def merged_impacts(impacts: DataFrame) -> DataFrame:
    """Impacts(scenario, attribute, relevance, score) merged per scenario: attributes, the relevance of the highest score (ties: the strongest), in order of reach."""
    rank = F.array_position(F.array(*map(F.lit, REACH)), F.col("relevance"))
    best = F.max(F.struct("score", (-rank).alias("near"), "relevance"))
    out = impacts.groupBy("scenario").agg(best.alias("best"), F.array_sort(F.collect_set("attribute")).alias("attributes"))
    order = F.array_position(F.array(*map(F.lit, REACH)), F.col("best.relevance"))
    return out.select("scenario", F.col("best.relevance").alias("relevance"), F.col("best.score").alias("score"), "attributes", order.cast("int").alias("reach_order"))


def owner_roles(hits: DataFrame, always: tuple[str, ...] = ("mapper", "helper")) -> DataFrame:
    """Shared owners per scope of hits(owner, scope, item): those with more than one distinct item, and mappers and helpers whatever they have.

    The role is the last word of the owner's name among mapper, helper, service, controller, else component."""
    role = F.coalesce(F.nullif(F.lower(F.regexp_extract("owner", r"(?i)(mapper|helper|service|controller)$", 1)), F.lit("")), F.lit("component"))
    out = hits.groupBy("owner", "scope").agg(F.count_distinct("item").alias("n_items")).withColumn("role", role)
    return out.where(F.col("role").isin(*always) | (F.col("n_items") > 1))


def domains(attributes: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The domain of an attribute, if just one: a token both of its owners and of its scenarios' names. attributes(attribute, token), scenarios(attribute, token)."""
    both = attributes.select("attribute", "token").distinct().join(scenarios.select("attribute", "token").distinct(), ["attribute", "token"])
    out = both.groupBy("attribute").agg(F.count("*").alias("n"), F.min("token").alias("token"))
    return attributes.select("attribute").distinct().join(out, "attribute", "left").select("attribute", F.when(F.col("n") == 1, F.col("token")).alias("domain"))


def mention_counts(bodies: DataFrame, attributes: DataFrame, most: int = 120) -> DataFrame:
    """(attribute, body_id, n): how often each body names an attribute as a whole word; the `most` bodies with most mentions of each."""
    words = bodies.select("body_id", F.explode(F.regexp_extract_all("body", F.lit(r"\w+"), F.lit(0))).alias("attribute"))
    counts = words.join(attributes.select("attribute").distinct(), "attribute").groupBy("attribute", "body_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("n"), "body_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def ordered_first(values: DataFrame, within: str, value: str, position: str, most: int) -> DataFrame:
    """The distinct values of each group, whatever the case, in the order of their first place, in the spelling found there; at most so many."""
    first = values.groupBy(within, F.lower(value).alias("_k")).agg(F.min(F.struct(position, value)).alias("f"))
    rank = F.row_number().over(Window.partitionBy(within).orderBy(f"f.{position}", F.col("_k")))
    return first.select(within, F.col("f")[value].alias(value), rank.alias("rank")).where(F.col("rank") <= most)


def first_wins(frames: list[DataFrame], key: str, most: int | None = None, within: str | None = None) -> DataFrame:
    """Union of frames of one shape; of rows with one key that of the earliest frame stays (within a frame the least row); at most so many per group."""
    every = None
    for at, df in enumerate(frames):
        one = df.withColumn("_at", F.lit(at))
        every = one if every is None else every.unionByName(one)
    rest = [c for c in frames[0].columns if c not in (key, within)]
    keys = [key] if within is None else [within, key]
    out = every.groupBy(*keys).agg(F.min(F.struct("_at", *rest)).alias("f"))
    if most is not None:
        rank = F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy("f._at", key))
        out = out.withColumn("_r", rank).where(F.col("_r") <= most)
    return out.select(*keys, *[F.col(f"f.{c}") for c in rest])


def best_per(rows: DataFrame, within: str, order: list[Column], most: int | None, least_score: tuple[str, float] | None = None) -> DataFrame:
    """rows with their rank in each group by a total order; at most so many, from a least score on."""
    if least_score:
        rows = rows.where(F.col(least_score[0]) >= least_score[1])
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(*order)))
    return out if most is None else out.where(F.col("rank") <= most)


def relevance_candidates(mentions: DataFrame, changed: DataFrame, explicit: DataFrame) -> DataFrame:
    """(change, ticket, n_matches): tickets that mention attributes of a change and are not linked to it explicitly."""
    met = changed.select("change", "attribute").distinct().join(mentions.select("ticket", "attribute").distinct(), "attribute")
    return met.groupBy("change", "ticket").agg(F.count("*").alias("n_matches")).join(explicit.select("change", "ticket"), ["change", "ticket"], "left_anti")


def ticket_lookup(tickets: DataFrame, attributes: DataFrame) -> DataFrame:
    """(attribute, ticket, matched_in, excerpt): tickets(ticket, title, text) whose title or text names an attribute as a whole word, the title first, with its surroundings."""
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "title", "text")), "[^a-z0-9_]+"))
    met = tickets.select("ticket", "title", "text", F.explode(words).alias("_w")).join(attributes.select("attribute", F.lower("attribute").alias("_w")).distinct(), "_w")
    in_title = F.array_contains(F.split(F.lower("title"), "[^a-z0-9_]+"), F.col("_w"))
    matched = F.when(in_title, "TITLE").otherwise("TEXT")
    source = F.when(in_title, F.col("title")).otherwise(F.col("text"))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(source), "[^a-z0-9_]", " "), F.lit(" "))
    place = F.position(F.concat(F.lit(" "), F.col("_w"), F.lit(" ")), padded)
    start = F.greatest(place - 100, F.lit(1))
    return met.select("attribute", "ticket", matched.alias("matched_in"), F.substring(source, start, place - start + F.length("_w") + 140).alias("excerpt"))


def plan_rows(results: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, item): one row for each rule of a table of rules that holds for a result."""
    return results.select(key, F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))).alias("item"))


def contract_diff(old: DataFrame, new: DataFrame, key: list[str], code: str) -> DataFrame:
    """(key, added, removed, changed) of two contracts with one row per (key, code) and columns to compare."""
    rest = [c for c in old.columns if c not in (*key, code)]
    a, b = (df.groupBy(*key, code).agg(F.max(F.struct(*rest)).alias(name)) for df, name in ((old, "a"), (new, "b")))
    both = a.join(b, [*key, code], "full_outer")
    pick = lambda test: F.array_sort(F.collect_set(F.when(test, F.col(code))))
    return both.groupBy(*key).agg(
        pick(F.col("a").isNull()).alias("added"), pick(F.col("b").isNull()).alias("removed"), pick(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
    )

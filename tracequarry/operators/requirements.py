"""From requirements to code: intents, scored methods and endpoints, confirmed concepts, and the evidence around them.

Evidence is one long table of (requirement, method, kind, item) made by joins on single words, keys and identifiers, and summed once;
requirements and methods never meet as pairs. Overlaps are CANDIDATE, only a stated ticket key is REFERENCED. Nulls meet nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.text import compact, is_test_path, tickets
from tracequarry.store import stored

# Words that show a behaviour.
BEHAVIOURS = {
    "ingest": "ingest receive request post create submit import",
    "xml": "xml parse deserialize marshal unmarshal",
    "validate": "validate validation reject invalid required check",
    "persist": "persist save repository entity database store",
    "map": "map mapper transform convert model entity",
}
# What a verb scores by the first rule of which an intent is wanted, and otherwise.
VERB_SCORES = {
    "GET": ([("READ", 6), ("BUSINESS_RULE", 1)], -2),
    "POST": ([("ADD PERSIST", 6), ("BUSINESS_RULE", 2)], 0),
    "PUT": ([("UPDATE", 6), ("ADD PERSIST BUSINESS_RULE", 3)], -1),
    "PATCH": ([("UPDATE", 6), ("ADD PERSIST BUSINESS_RULE", 3)], -1),
    "DELETE": ([("REMOVE", 6)], -10),
}


def letters(text: Column, least: int = 3) -> Column:
    """Distinct lower-case runs of letters, camelCase opened; null gives none."""
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]+"), F.lit(0))
    return F.coalesce(F.array_distinct(F.filter(runs, lambda w: F.length(w) >= least)), F.array().cast("array<string>"))


def intents(texts: DataFrame, vocabulary: DataFrame, key: str, default: str = "CHANGE") -> DataFrame:
    """(key, intents): sorted intents of which a word stands in the text, else the default. texts(key, text), vocabulary(intent, word)."""
    words = texts.select(key, F.explode(letters(F.col("text"), 1)).alias("word"))
    found = words.join(vocabulary.select("intent", F.lower("word").alias("word")).distinct(), "word").groupBy(key).agg(F.array_sort(F.collect_set("intent")).alias("intents"))
    return texts.select(key).distinct().join(found, key, "left").withColumn("intents", F.coalesce("intents", F.array(F.lit(default))))


def operation_score(verb: Column, wanted: Column, name: Column) -> Column:
    """What an endpoint's verb says about an array of intents, by VERB_SCORES; a PUT or PATCH that suits none scores 1 if its method's name says update,
    replace or patch. Other verbs score 0."""
    score = F.when(verb.isNull(), 0)
    for v, (rules, otherwise) in VERB_SCORES.items():
        for names, points in rules:
            score = score.when((verb == v) & F.arrays_overlap(wanted, F.array(*map(F.lit, names.split()))), points)
        if v in ("PUT", "PATCH"):
            score = score.when((verb == v) & F.arrays_overlap(letters(name), F.array(*map(F.lit, ("update", "replace", "patch")))), 1)
        score = score.when(verb == v, otherwise)
    return score.otherwise(0)


def endpoint_candidates(requirements: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(requirement, endpoint, n_subjects, operation, score) of endpoints that share a subject word with a requirement: 3, one more for each word up to three,
    and the score of the operation. A DELETE counts only where REMOVE is wanted.

    requirements(requirement, subjects, intents), endpoints(endpoint, verb, name, words)."""
    a = requirements.select("requirement", F.explode(F.array_distinct("subjects")).alias("_w"))
    b = endpoints.select("endpoint", F.explode(F.array_distinct("words")).alias("_w"))
    met = a.join(b, "_w").groupBy("requirement", "endpoint").agg(F.count("*").alias("n_subjects"))
    out = met.join(requirements.select("requirement", "intents"), "requirement").join(endpoints.select("endpoint", F.upper("verb").alias("verb"), "name"), "endpoint")
    out = out.where((F.coalesce("verb", F.lit("")) != "DELETE") | F.array_contains("intents", "REMOVE")).withColumn("operation", operation_score(F.col("verb"), F.col("intents"), F.col("name")))
    return out.select("requirement", "endpoint", "n_subjects", "operation", (3 + F.least("n_subjects", F.lit(3)) + F.col("operation")).alias("score"))


def method_candidates(requirements: DataFrame, methods: DataFrame, attributes: DataFrame, behaviours: dict[str, str] = BEHAVIOURS) -> DataFrame:
    """(requirement, method, name, n_terms, n_behaviours, n_attributes, direct, score, classification, seed) of methods that show evidence of a requirement.

    0.22 for each shared term of owner and name up to four, 0.18 for each shared behaviour, 1.1 if the method names an attribute, 0.35 if its body states the
    ticket. Accessors, main, and methods that change or remove what nobody asked to be changed need the ticket and lose 0.65 and 0.5. A method without the
    ticket needs a behaviour, an attribute or a term in its own name, and 0.15. seed: 0.55 or more, for `called_candidates`.

    requirements(requirement, ticket, text), methods(method, owner, name, body), attributes(requirement, attribute): identifiers meet as wholes, accessors by
    what they access."""
    r = requirements.select("requirement", F.upper(F.trim("ticket")).alias("ticket"), letters(F.col("text")).alias("words"))
    m = methods.select("method", "name", letters(F.concat_ws(" ", "owner", "name")).alias("terms"), letters(F.col("name")).alias("own"), "body")
    groups = lambda words: F.filter(F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, w.split()))), F.lit(k)) for k, w in behaviours.items())), lambda x: x.isNotNull())
    names = F.regexp_extract_all(F.concat_ws(" ", "name", "body"), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    names = F.array_distinct(F.transform(names, lambda n: compact(F.regexp_replace(n, "^(get|set|is)(?=[A-Z])", ""))))

    def by(kind: str, left: DataFrame, items: Column) -> DataFrame:
        right = m.select("method", "own", F.explode(items).alias("item")).select("method", "item", F.expr("array_contains(own, item)").alias("_o"))
        return left.join(right, "item").select("requirement", "method", F.lit(kind).alias("kind"), (F.lit(kind == "term") & F.col("_o")).alias("_o"))

    found = [
        by("term", r.select("requirement", F.explode("words").alias("item")), F.col("terms")),
        by("behaviour", r.select("requirement", F.explode(groups(F.col("words"))).alias("item")), groups(F.col("own"))),
        by("attribute", attributes.select("requirement", compact(F.col("attribute")).alias("item")).where("length(item) >= 5").distinct(), names),
        by("direct", r.select("requirement", F.col("ticket").alias("item")), tickets(F.upper("body"))),
    ]
    n = lambda kind: F.count_if(F.col("kind") == kind)
    sums = reduce(DataFrame.unionByName, found).groupBy("requirement", "method").agg(
        n("term").alias("n_terms"), n("behaviour").alias("n_behaviours"), n("attribute").alias("n_attributes"), (n("direct") > 0).alias("direct"), F.max("_o").alias("_own"),
    )
    changes = F.arrays_overlap("words", F.array(F.lit("update"), F.lit("delete")))
    out = sums.join(m.select("method", "name"), "method").join(r.select("requirement", changes.alias("_changes")), "requirement")
    plain = _accessor(F.col("name")) | (F.col("name") == "main")
    odd = F.col("name").rlike("(?i)^(delete|replace|update|remove)") & ~F.col("_changes")
    score = 0.22 * F.least("n_terms", F.lit(4)) + 0.18 * F.col("n_behaviours") + F.when(F.col("n_attributes") > 0, 1.1).otherwise(0.0) + F.when(F.col("direct"), 0.35).otherwise(0.0)
    score = F.round(score - F.when(plain, 0.65).otherwise(0.0) - F.when(odd, 0.5).otherwise(0.0), 3)
    shown = F.col("_own") | (F.col("n_behaviours") > 0) | (F.col("n_attributes") > 0)
    out = out.withColumn("score", score).where(F.col("direct") | (~(plain | odd) & shown & (F.col("score") >= 0.15)))
    return out.select(
        "requirement", "method", "name", "n_terms", "n_behaviours", "n_attributes", "direct", F.greatest("score", F.lit(0.0)).alias("score"),
        F.when(F.col("direct"), "REFERENCED").otherwise("CANDIDATE").alias("classification"), (~(plain | odd) & (F.col("score") >= 0.55)).alias("seed"),
    )


def _accessor(name: Column) -> Column:
    return name.rlike("^(get|set|is)[A-Z]")


def called_candidates(candidates: DataFrame, calls: DataFrame, methods: DataFrame, hops: int = 2) -> DataFrame:
    """(requirement, method, score, call_depth, n_calls, classification): candidates and what their seeds call within `hops`, once and at the least depth.

    A called method scores 0.35 over its depth; accessors are passed through but not taken. All get 0.12 for each call of theirs to a known method,
    up to three. calls(method, callee), methods(method, name)."""
    known = methods.select("method", "name").distinct()
    edges = calls.select("method", "callee").distinct().join(known.select(F.col("method").alias("callee")), "callee", "left_semi").where("method <> callee")
    first = stored(candidates.select("requirement", "method", "score", "classification", "seed"), "candidates")  # read once for each hop
    seen = front = first.where("seed").select("requirement", "method", F.lit(0).alias("call_depth"))
    for depth in range(1, hops + 1):
        ahead = front.join(edges, "method").select("requirement", F.col("callee").alias("method")).distinct()
        front = ahead.join(seen, ["requirement", "method"], "left_anti").withColumn("call_depth", F.lit(depth))
        seen = seen.unionByName(front)
    new = seen.where("call_depth > 0").join(first, ["requirement", "method"], "left_anti").join(known, "method").where(~_accessor(F.col("name")))
    new = new.select("requirement", "method", F.round(F.lit(0.35) / F.col("call_depth"), 3).alias("score"), "call_depth", F.lit("CANDIDATE").alias("classification"))
    every = first.select("requirement", "method", "score", F.lit(0).alias("call_depth"), "classification").unionByName(new)
    every = every.join(edges.groupBy("method").agg(F.count("*").alias("n_calls")), "method", "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))
    return every.withColumn("score", F.round(F.col("score") + 0.12 * F.least("n_calls", F.lit(3)), 3))


def confirmed(concepts: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """concepts(key, concept) with status CONFIRMED if the concept, compacted, is an entity of the key, else CANDIDATE_ONLY. entities(key, entity)."""
    known = entities.select(key, compact(F.col("entity")).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    out = concepts.select(key, "concept").withColumn("_k", compact(F.col("concept"))).join(known, [key, "_k"], "left")
    return out.select(key, "concept", F.when(F.col("_hit"), "CONFIRMED").otherwise("CANDIDATE_ONLY").alias("status"))


def narrowed(chunks: DataFrame, kind: str, kinds: list[str], scope: str | None = None, wanted: str | None = None) -> DataFrame:
    """chunks of some kinds and, if stated, of one scope, as comparisons that reach the scan. No kinds stands for all."""
    out = chunks.where(F.col(kind).isin(kinds)) if kinds else chunks
    return out if scope is None or wanted is None else out.where(F.col(scope) == wanted)


def counts_by_scope(rows: DataFrame, scope: str, reference: str, name: str) -> DataFrame:
    """(scope, n_files, n_records): rows and distinct files of each scope; a file is its reference or, without one, its name, whatever the case."""
    file = F.lower(F.coalesce(reference, name))
    each = rows.groupBy(scope, file.alias("_f")).agg(F.count("*").alias("_n"))  # a hot scope is spread over its files
    return each.groupBy(scope).agg(F.count("_f").alias("n_files"), F.sum("_n").alias("n_records"))


def bucketed(evidence: DataFrame, key: str, kind: str, buckets: dict[str, str], item: str, first: int | None = None, other: str = "other") -> DataFrame:
    """(key, bucket, n_items, items): evidence by the bucket of its kind, items distinct and sorted; with `first`, only so many of each are listed."""
    bucket = F.coalesce(F.create_map(*(F.lit(x) for kv in buckets.items() for x in kv))[F.col(kind)], F.lit(other))
    each = evidence.select(key, bucket.alias("bucket"), item).where(F.col(item).isNotNull()).distinct()
    if first is None:
        return each.groupBy(key, "bucket").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(item)).alias("items"))
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy(key, "bucket").orderBy(item)))
    return ranked.groupBy(key, "bucket").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.when(F.col("_r") <= first, F.col(item)))).alias("items"))


def paired_conditions(removed: DataFrame, added: DataFrame) -> DataFrame:
    """The i-th removed condition of a file and left side with the i-th added one, if operator or number differ. Both: (file, line, lhs, operator, number).

    Left sides meet whatever their case. Pairs are made by place first and compared after, so a pair without a change uses up both."""
    at = F.row_number().over(Window.partitionBy("file", "_l").orderBy("line", "operator", "number"))
    side = lambda df, s: df.withColumn("_l", F.lower("lhs")).select("file", "_l", at.alias("_i"), F.col("line").alias(f"{s}_line"), F.col("operator").alias(f"{s}_operator"), F.col("number").alias(f"{s}_number"))
    met = side(removed, "old").join(side(added, "new"), ["file", "_l", "_i"])
    changed = ~(F.col("old_operator").eqNullSafe(F.col("new_operator")) & F.col("old_number").eqNullSafe(F.col("new_number")))
    return met.where(changed).withColumnRenamed("_l", "lhs").drop("_i")


def constant_attributes(constants: DataFrame, lines: DataFrame) -> DataFrame:
    """(attribute, constant) where a line of the constant's own file applies it to a getter. constants(path, constant) of changed constants,
    lines(path, text); files of tests do not count."""
    words = lines.where(~is_test_path(F.col("path"))).select("path", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("constant"))
    met = words.join(constants.select("path", "constant").distinct(), ["path", "constant"], "left_semi")
    got = met.select("constant", F.explode(F.regexp_extract_all("text", F.lit(r"\bget([A-Z][A-Za-z0-9_]*)\s*\("), F.lit(1))).alias("_g"))
    return got.select(F.concat(F.lower(F.substring("_g", 1, 1)), F.expr("substring(_g, 2)")).alias("attribute"), "constant").distinct()


def branch_evidence(branches: DataFrame, attributes: DataFrame) -> DataFrame:
    """(attribute, class_name, method, type, condition), distinct, of branches whose list of attributes holds the attribute, compacted.

    branches(class_name, method, type, condition, attributes array), attributes(attribute)."""
    open_ = branches.select("class_name", "method", "type", "condition", F.explode(F.array_distinct(F.transform("attributes", lambda a: compact(a)))).alias("_k"))
    asked = attributes.select("attribute", compact(F.col("attribute")).alias("_k")).where("_k <> ''").distinct()
    return open_.join(asked, "_k").select("attribute", "class_name", "method", "type", "condition").distinct()

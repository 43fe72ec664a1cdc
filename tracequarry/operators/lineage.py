"""Lineage of attributes: roles of classes, contracts of mappings with the calls that reach them, impact of changed mappings, and where a value diverges.

What is found in source text by its form is a candidate and stays one; nothing here calls a path proven.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators.graph import impact
from tracequarry.store import hot_keys, met, scratch, stored

#: The roles that annotations give, and the base types that make a repository.
ANNOTATION_ROLES = {
    "ENTITY": ("Entity", "Table"),
    "CONTROLLER": ("RestController", "Controller"),
    "SERVICE": ("Service",),
    "REPOSITORY": ("Repository",),
    "MAPPER": ("Mapper",),
}
REPOSITORY_BASES = ("JpaRepository", "CrudRepository", "PagingAndSortingRepository")
PLAIN = "JAVA_CLASS"


def propagated(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label, seed, depth): every label passed along edges to all that they reach, with the least of the seeds that are nearest.

    labels(node, label), edges(source, target). All labels go a step at a time, together, until nothing is new, so cycles end; a step is a table. A node with
    very many edges is met by broadcasting its few labels."""
    with scratch(labels.sparkSession):
        steps = stored(edges.select("source", "target").where("source is not null and target is not null").distinct(), "label-edges")
        hot = hot_keys(steps, "source")
        first = labels.where("node is not null and label is not null").select("node", "label", F.col("node").alias("seed"), F.lit(0).alias("depth")).distinct()
        seen = frontier = stored(first, "labels", keep=True)
        depth = 0
        while not frontier.isEmpty():
            depth += 1
            carried = frontier.groupBy(F.col("node").alias("source")).agg(F.collect_list(F.struct("label", "seed")).alias("ls"))  # at most one for each label
            ahead = met(steps, carried, "source", hot).select(F.col("target").alias("node"), F.explode("ls").alias("l")).groupBy("node", F.col("l.label").alias("label")).agg(F.min("l.seed").alias("seed"))
            frontier = stored(ahead.join(seen.select("node", "label"), ["node", "label"], "left_anti").withColumn("depth", F.lit(depth)), "labels", keep=True)
            seen = seen.unionByName(frontier)
    return seen


def class_roles(classes: DataFrame, signatures: DataFrame, fields: DataFrame) -> DataFrame:
    """(class_name, role, seed, depth): every role of each class, several if it has several.

    classes(class_name, annotations array, bases array), signatures(class_name, body_types array, return_types array) of methods, those with an HTTP mapping;
    fields(class_name, type). Annotations and base types give roles by ANNOTATION_ROLES; COMPONENT only counts where there is no Mapper. What methods of a
    controller take as body is a REQUEST_MODEL, what they return a RESPONSE_MODEL, and both roles pass on to the types of fields, as far as these
    are classes of the project; seed is the class of the signature that a role comes from, depth the fields on the way. A class without any role is
    PLAIN. Names of a class given twice count once, with all their annotations; nulls count for nothing."""
    named = classes.where("class_name is not null")
    marks = named.select("class_name", F.explode("annotations").alias("mark")).distinct()
    of_mark = [(mark, role) for role, marks_ in ANNOTATION_ROLES.items() for mark in marks_] + [("Component", "COMPONENT")]
    role = F.create_map(*(F.lit(x) for pair in of_mark for x in pair))
    annotated = marks.select("class_name", "mark", role[F.col("mark")].alias("role")).where("role is not null")
    mappers = annotated.where("role = 'MAPPER'").select("class_name").distinct()
    components = annotated.where("role = 'COMPONENT'").join(mappers, "class_name", "left_anti")
    based = named.where(F.arrays_overlap("bases", F.array(*map(F.lit, REPOSITORY_BASES)))).select("class_name", F.lit("REPOSITORY").alias("role"))
    own = annotated.where("role <> 'COMPONENT'").select("class_name", "role").unionByName(components.select("class_name", "role")).unionByName(based).distinct()
    known = named.select("class_name").distinct()
    with scratch(classes.sparkSession):
        own = stored(own, "own-roles", keep=True)
        said = signatures.join(own.where("role = 'CONTROLLER'").select("class_name"), "class_name", "left_semi")
        models = reduce(DataFrame.unionByName, [said.select(F.explode(c).alias("node"), F.lit(r).alias("label")) for c, r in (("body_types", "REQUEST_MODEL"), ("return_types", "RESPONSE_MODEL"))])
        is_known = lambda df, c: df.join(known.withColumnRenamed("class_name", c), c, "left_semi")
        edges = is_known(is_known(fields.select(F.col("class_name").alias("source"), F.col("type").alias("target")), "source"), "target")
        passed = stored(propagated(is_known(models.distinct(), "node"), edges), "model-roles", keep=True)
    every = own.select("class_name", "role", F.col("class_name").alias("seed"), F.lit(0).alias("depth")).unionByName(passed.select(F.col("node").alias("class_name"), F.col("label").alias("role"), "seed", "depth"))
    plain = known.join(every.select("class_name"), "class_name", "left_anti").select("class_name", F.lit(PLAIN).alias("role"), F.col("class_name").alias("seed"), F.lit(0).alias("depth"))
    return every.unionByName(plain)


def contract_checks(mappings: DataFrame, setters: DataFrame, methods: DataFrame) -> DataFrame:
    """(attribute, method, expression, status, file, line): calls of setters of attributes whose mapping expects a trimmed value.

    mappings(target, mapping_rule, validation_rule), setters(class_name, method, attribute, expression, file, line), methods(class_name, method, trims). A
    target is met by the name after its last dot, case aside. LOCAL_TRIM_PRESENT where the expression trims; HELPER_TRIM_PRESENT_CANDIDATE where it is a call of
    the one method of that name in the same class, which trims somewhere; POTENTIAL_MISMATCH_NO_LOCAL_TRIM else."""
    rule = F.concat_ws(" ", "mapping_rule", "validation_rule")
    expected = mappings.where(rule.rlike(r"(?i)\btrim\b")).select(F.lower(F.substring_index("target", ".", -1)).alias("_a")).where("_a <> ''").distinct()
    asked = setters.withColumn("_a", F.lower("attribute")).join(expected, "_a", "left_semi").drop("_a")
    call = F.regexp_extract(F.trim("expression"), r"(?s)^(?:this\.)?([A-Za-z_$][\w$]*)\s*\(.*\)$", 1)
    helpers = methods.groupBy("class_name", F.col("method").alias("_helper")).agg((F.count("*") == 1).alias("_one"), F.max("trims").alias("_trims"))
    found = asked.withColumn("_helper", call).join(helpers, ["class_name", "_helper"], "left")
    status = (
        F.when(F.col("expression").rlike(r"\.trim\s*\("), "LOCAL_TRIM_PRESENT")
        .when(F.coalesce(F.col("_one") & F.col("_trims"), F.lit(False)), "HELPER_TRIM_PRESENT_CANDIDATE")
        .otherwise("POTENTIAL_MISMATCH_NO_LOCAL_TRIM")
    )
    return found.select("attribute", F.concat("class_name", F.lit("."), "method").alias("method"), "expression", status.alias("status"), "file", "line").distinct()


def _other_field(method: Column, attribute: Column) -> Column:
    """Whether a method's name says that it updates another field than the attribute."""
    field = F.regexp_extract(F.substring_index(method, ".", -1), "^(?:update|patch|set)([A-Z][A-Za-z0-9_]*)$", 1)
    return (field != "") & (F.lower(field) != F.lower(attribute))


def contract_paths(checks: DataFrame, calls: DataFrame, endpoints: DataFrame, observed: DataFrame, hops: int = 2) -> DataFrame:
    """(attribute, chain, http_method, endpoint, file, line): ways from an endpoint's method down to the setter of a checked attribute.

    checks(attribute, method), calls(caller, receiver_type, name, file, line) with caller as Class.method and the declared type of the receiver (null: not
    declared), endpoints(method, http_method, endpoint), observed(attribute, method) of methods whose source names the attribute. The search goes
    against the calls, `hops` at most, from all checked methods at once, and carries its path: a step counts only if the receiver's declared type is the class of the
    called method, never stays within that class at the first step, and never repeats a method. A way ends at a method with an endpoint; it is left
    out if a method on it, the last aside, updates another field by its name. A single step without an endpoint stays if its caller names the
    attribute itself and no way that is kept ends with it; its endpoint is null. Equal ways with several places of the first call have the least one."""
    typed = calls.where("receiver_type is not null").select("caller", F.concat("receiver_type", F.lit("."), "name").alias("callee"), "file", "line")
    typed = typed.groupBy("caller", "callee").agg(F.min(F.struct("file", "line")).alias("at")).where("caller <> callee")
    own = lambda c: F.substring_index(c, ".", 1)
    with scratch(checks.sparkSession):
        typed = stored(typed, "typed-calls")
        seeds = checks.select("attribute", "method").distinct()
        level = stored(seeds.select("attribute", F.array("method").alias("chain"), F.lit(None).cast("struct<file:string,line:long>").alias("below")), "chains", keep=True)
        every = None
        for hop in range(hops):
            if level.isEmpty():
                break
            ahead = level.withColumn("callee", F.element_at("chain", 1))
            up = ahead.join(typed, "callee").where(~F.array_contains("chain", F.col("caller")))
            if hop == 0:
                up = up.where(own("caller") != own("callee"))
            place = F.coalesce("below", F.struct(F.col("at.file").cast("string").alias("file"), F.col("at.line").cast("long").alias("line")))
            level = stored(up.select("attribute", F.concat(F.array("caller"), "chain").alias("chain"), place.alias("below")), "chains", keep=True)
            every = level if every is None else every.unionByName(level)
        every = level if every is None else every
        at = every.where("size(chain) > 1").withColumnRenamed("below", "at").withColumn("method", F.element_at("chain", 1))
        reached = at.join(endpoints.select("method", "http_method", "endpoint").where("endpoint is not null").distinct(), "method")
        wrong = F.exists(F.slice("chain", 1, F.size("chain") - 1), lambda m: _other_field(m, F.col("attribute")))
        kept = stored(reached.where(~wrong).select("attribute", "chain", "http_method", "endpoint", "at"), "reached", keep=True)
        tails = kept.select("attribute", F.slice("chain", -2, 2).alias("chain")).distinct()
        lone = at.where("size(chain) = 2").join(observed.select("attribute", "method").distinct(), ["attribute", "method"], "left_semi").join(tails, ["attribute", "chain"], "left_anti")
    nothing = F.lit(None).cast("string")
    out = kept.unionByName(lone.select("attribute", "chain", nothing.alias("http_method"), nothing.alias("endpoint"), "at"))
    return out.select("attribute", "chain", "http_method", "endpoint", F.col("at.file").alias("file"), F.col("at.line").alias("line"))


def contract_edges(observed: DataFrame, paths: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(source, target, status, file, line), each once: what the paths of contracts say as edges between attributes, methods, endpoints and scenarios.

    observed(attribute, method, file, line), paths as of contract_paths, scenarios(scenario, http_method, endpoint). Different places of one relation stay different edges;
    endpoints are compared without outer slashes, case aside. An endpoint that matches a scenario says nothing about a run of it."""
    verb = F.upper(F.coalesce("http_method", F.lit("")))
    api = F.concat(F.lit("api:"), verb, F.lit(" "), F.col("endpoint"))
    key = F.concat(verb, F.lit(" /"), F.lower(F.regexp_replace(F.translate("endpoint", "\\", "/"), r"^\s*/*|/*\s*$", "")))
    nowhere = [F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line")]
    named = lambda c: F.concat(F.lit("method:"), c)
    edge = lambda df, a, b, status, place: df.select(a.alias("source"), b.alias("target"), F.lit(status).alias("status"), *place)
    steps = paths.select(F.explode(F.arrays_zip(F.slice("chain", 1, F.size("chain") - 1).alias("a"), F.slice("chain", 2, F.size("chain") - 1).alias("b"))).alias("s"))
    ended = paths.where("endpoint is not null")
    matched = ended.select(api.alias("_api"), key.alias("_k")).distinct().join(scenarios.select("scenario", key.alias("_k")).distinct(), "_k")
    kinds = [
        edge(observed, F.concat(F.lit("attribute:"), "attribute"), named(F.col("method")), "SOURCE_REFERENCE_ONLY", [F.col("file").cast("string").alias("file"), F.col("line").cast("long").alias("line")]),
        edge(steps, named(F.col("s.a")), named(F.col("s.b")), "LEXICAL_NOT_TYPE_RESOLVED", nowhere),
        edge(ended, api, named(F.element_at("chain", 1)), "ENDPOINT_SOURCE_CANDIDATE", nowhere),
        edge(matched, F.col("_api"), F.concat(F.lit("scenario:"), F.col("scenario")), "ENDPOINT_MATCH_ONLY", nowhere),
    ]
    return reduce(DataFrame.unionByName, kinds).dropDuplicates(["source", "target", "status", "file", "line"])


def mapping_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(family, attribute, status, old_target, new_target): definitions of two versions of mappings, met by family and target expression, case aside.

    Both: (family, attribute, target, rule). ADDED, REMOVED, CHANGED (another rule) or UNCHANGED; RENAMED where a family's attribute has exactly one removed and
    exactly one added target: then one row names both. Of equal targets the greatest rule counts; null targets are no definitions."""
    side = lambda df, s: df.where("target is not null").groupBy("family", F.lower("target").alias("_t")).agg(F.max(F.struct("rule", "target", "attribute")).alias(s))
    both = side(old, "o").join(side(new, "n"), ["family", "_t"], "full_outer")
    status = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "REMOVED").when(F.col("o.rule").eqNullSafe(F.col("n.rule")), "UNCHANGED").otherwise("CHANGED")
    rows = both.select("family", F.coalesce("n.attribute", "o.attribute").alias("attribute"), status.alias("status"), F.col("o.target").alias("old_target"), F.col("n.target").alias("new_target"))
    count = lambda s: F.count_if(F.col("status") == s)
    groups = rows.groupBy("family", F.lower("attribute").alias("_k")).agg(count("REMOVED").alias("_r"), count("ADDED").alias("_a"), F.max(F.when(F.col("status") == "REMOVED", F.col("old_target"))).alias("_from"), F.max(F.when(F.col("status") == "ADDED", F.col("new_target"))).alias("_to"))
    renames = groups.where("_r = 1 and _a = 1").select("family", "_k", "_from", "_to")
    known = rows.withColumn("_k", F.lower("attribute")).join(renames, ["family", "_k"], "left")
    is_pair = F.col("_from").isNotNull() & F.col("status").isin("ADDED", "REMOVED")
    kept = known.where(~(is_pair & (F.col("status") == "REMOVED")))
    return kept.select("family", "attribute", F.when(is_pair, "RENAMED").otherwise(F.col("status")).alias("status"), F.when(is_pair, F.col("_from")).otherwise(F.col("old_target")).alias("old_target"), F.when(is_pair, F.col("_to")).otherwise(F.col("new_target")).alias("new_target"))


def mapping_change_impact(changes: DataFrame, nodes: DataFrame, edges: DataFrame, up_types: list[str], down_types: list[str], up: int = 8, down: int = 5) -> DataFrame:
    """(family, kind, target, other, depth): what changed mappings reach in the graph of the code, and their risks.

    changes as of mapping_changes, nodes(id, name), edges(source, target, type). RENAME (target to other); CALLERS and BUSINESS: nodes (other) that old and new targets
    reach, both sides of a rename, by their names after the last dot, case aside; TARGET_NOT_FOUND_IN_CODE for each new target without a node;
    REMOVED_MAPPING with the number of removed definitions of the family as depth."""
    short = lambda c: F.lower(F.substring_index(c, ".", -1))
    changed = changes.where("status <> 'UNCHANGED'")
    targets = changed.select("family", F.explode(F.array("old_target", "new_target")).alias("target")).where("target is not null").distinct()
    found = nodes.select(F.col("id").alias("seed"), F.lower("name").alias("_n"))
    with scratch(changes.sparkSession):
        placed = stored(targets.withColumn("_n", short("target")).join(found, "_n"), "changed-targets", keep=True)
        reached = stored(impact(edges, placed.select("seed").distinct(), up_types, down_types, up, down), "changed-impact", keep=True)
    row = lambda df, kind, target, other, depth: df.select("family", kind.alias("kind"), target.alias("target"), other.cast("string").alias("other"), depth.cast("long").alias("depth"))
    nothing = F.lit(None)
    met_ = placed.select("family", "target", "seed").join(reached, "seed").groupBy("family", "target", "direction", "node").agg(F.min("depth").alias("depth"))
    absent = changed.select("family", F.col("new_target").alias("target")).where("target is not null").distinct().withColumn("_n", short("target")).join(found, "_n", "left_anti")
    removed = changed.where("status = 'REMOVED'").groupBy("family").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [
        row(changed.where("status = 'RENAMED'"), F.lit("RENAME"), F.col("old_target"), F.col("new_target"), nothing),
        row(met_, F.col("direction"), F.col("target"), F.col("node"), F.col("depth")),
        row(absent, F.lit("TARGET_NOT_FOUND_IN_CODE"), F.col("target"), F.lit("HIGH"), nothing),
        row(removed, F.lit("REMOVED_MAPPING"), nothing.cast("string"), F.lit("MEDIUM"), F.col("n")),
    ])


#: How much each use of an attribute weighs where its value went wrong, and the uses that are risks by themselves.
WEIGHTS = {
    "NULL_OVERWRITE": 120, "MISSING_MAPPING": 115, "CONDITIONAL_PATH": 100, "VALUE_TRANSFORMED": 110, "VALUE_OVERWRITTEN": 125,
    "OVERWRITE": 85, "MAPPING": 70, "ASSIGNMENT": 65, "PERSISTENCE": 45, "READ": 20, "REFERENCE": 10,
}
RISKS = ("NULL_OVERWRITE", "CONDITIONAL_PATH", "VALUE_TRANSFORMED")
#: Fixed value: calls that change a value.
TRANSFORMS = r"\.(?:trim|strip|toLowerCase|toUpperCase|replace|substring)\s*\(|Optional\.|Objects\.|String\.format|valueOf\s*\("
_LITERAL = r"""(null|true|false|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|-?\d+(?:\.\d+)?)"""


def _pattern(*parts: str | Column) -> Column:
    return F.concat(F.lit("(?i)"), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _matches(text: Column, *parts: str | Column) -> Column:
    return F.coalesce(F.regexp_like(text, _pattern(*parts)), F.lit(False))


def classified(events: DataFrame) -> DataFrame:
    """events with usage and score: what a line of code does to an attribute's value.

    events(attribute, code, usage_type, direct): usage_type as found before (null: none), direct adds 20. Attributes are names of letters, digits and _. Comments do nothing
    (COMMENTED_OUT, 0). A setter or an assignment of null is a NULL_OVERWRITE; of a changed value VALUE_TRANSFORMED, else MAPPING (setter) or ASSIGNMENT; a
    condition that the attribute takes part in is a CONDITIONAL_PATH; then come PERSISTENCE, READ, the usage found before, and REFERENCE."""
    a, code = F.col("attribute"), F.trim(F.coalesce("code", F.lit("")))
    before = F.upper(F.coalesce("usage_type", F.lit("")))
    comment = code.startswith("//") | code.startswith("*") | (code.startswith("/*") & code.endswith("*/"))
    found = lambda *p: F.regexp_substr(code, _pattern(*p))
    set_ = F.trim(F.regexp_replace(found(r"\.set", a, r"\s*\(.*?\)"), _pattern(r"^\.set", a, r"\s*\(|\)$"), F.lit("")))
    assigned = F.trim(F.regexp_replace(found(r"\b", a, r"\s*=\s*(?!=).+?;?$"), _pattern("^", a, r"\s*=\s*|;$"), F.lit("")))
    reads = (r"\.(?:get|is)", a, r"\s*\(\s*\)|\.", a, r"\s*\(\s*\)")

    def transformed(text: Column) -> Column:
        plain = _matches(text, r"^(?:[A-Za-z_]\w*\.(?:", a, "|(?:get|is)", a, r")\s*\(\s*\)|[A-Za-z_]\w*)$")
        return ~plain & (_matches(text, TRANSFORMS) | F.contains(text, F.lit("+")))

    in_condition = lambda text: _matches(text, r"\b", a, r"\b|", *reads)
    ifs = F.exists(F.regexp_extract_all(code, F.lit(r"(?i)\bif\s*\((.*?)\)"), F.lit(1)), in_condition)
    asked = F.contains(code, F.lit("?")) & in_condition(F.substring_index(code, "?", 1))
    both = (F.contains(code, F.lit("&&")) | F.contains(code, F.lit("||"))) & in_condition(code)
    usage = (
        F.when(comment, "COMMENTED_OUT")
        .when(set_.isNotNull(), F.when(_matches(set_, r"\bnull\b"), "NULL_OVERWRITE").when((before == "VALUE_TRANSFORMED") | transformed(code) | transformed(set_), "VALUE_TRANSFORMED").otherwise("MAPPING"))
        .when(assigned.isNotNull(), F.when(_matches(assigned, r"\bnull\b"), "NULL_OVERWRITE").when(transformed(assigned), "VALUE_TRANSFORMED").otherwise("ASSIGNMENT"))
        .when(ifs | asked | both, "CONDITIONAL_PATH")
        .when(_matches(code, r"\.save\(|repository\.save"), "PERSISTENCE")
        .when(_matches(code, *reads), "READ")
        .when(before != "", before)
        .otherwise("REFERENCE")
    )
    weight = F.coalesce(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))[F.col("usage")], F.lit(10))
    direct = F.when(F.coalesce("direct", F.lit(False)), 20).otherwise(0)
    return events.withColumn("usage", usage).withColumn("score", F.when(F.col("usage") == "COMMENTED_OUT", 0).otherwise(weight + direct))


def divergence_ranking(events: DataFrame, first: int | None = 12) -> DataFrame:
    """(defect, attribute, class_name, method, line, step, code, usage, score, rank): where a defect's value may have gone wrong, most likely first.

    events(defect, attribute, class_name, method, line, step, code, usage_type, direct): what the trace of a defect's attribute met, step is its place on the call path. One line of code
    of a method counts once, at its first step. Ranked by score, then line (null: last), step, class, method and code; `first` keeps the top of each, None all."""
    keys = ["defect", "attribute", "class_name", "method", "line", "code"]
    met_ = events.groupBy(*keys).agg(F.min("step").alias("step"), F.max("usage_type").alias("usage_type"), F.bool_or(F.coalesce("direct", F.lit(False))).alias("direct"))
    order = Window.partitionBy("defect", "attribute").orderBy(F.desc("score"), F.asc_nulls_last("line"), "step", "class_name", "method", "code")
    ranked = classified(met_).withColumn("rank", F.row_number().over(order)).select("defect", "attribute", "class_name", "method", "line", "step", "code", "usage", "score", "rank")
    return ranked if first is None else ranked.where(F.col("rank") <= first)


def likely_divergence(ranking: DataFrame, defects: DataFrame) -> DataFrame:
    """(defect, attribute, classification, confidence, class_name, method, line): the one place of each defect that its evidence points to.

    ranking: all rows of divergence_ranking (first=None), defects(defect, attribute, expected, actual, input). In this order: no input value; the first risk of the ranking; no
    mapping at all where a value is missing (HIGH, at a commented-out write, if there is one); a literal equal to the actual value that is written after
    another write of the same method (a line that is not known, null, is after all others); the strongest mapping; nothing. Accessors of plain models are no mappings."""
    a = F.col("attribute")
    writes = _matches(F.col("code"), r"\.set", a, r"\s*\(|\b", a, r"\s*=")
    accessor = F.lower("method").isin(F.lower(F.concat(F.lit("get"), a)), F.lower(F.concat(F.lit("set"), a)), F.lower(F.concat(F.lit("is"), a)))
    declared = F.col("code").rlike("public |private |protected ") & _matches(F.col("code"), r"\b(?:get|set|is)", a, r"\s*\(")
    rows = ranking.withColumns({"_w": writes, "_map": F.col("usage").isin("MAPPING", "ASSIGNMENT") & ~F.coalesce(accessor | declared, F.lit(False))})
    at = F.struct("rank", "usage", "class_name", "method", "line")
    earlier = F.max(F.when(F.col("_w"), F.col("line"))).over(Window.partitionBy("defect", "attribute", "class_name", "method").orderBy(F.asc_nulls_last("line")).rangeBetween(Window.unboundedPreceding, -1))
    literal = F.coalesce(F.regexp_extract(F.regexp_substr("code", _pattern(r"\.set", a, r"\s*\(\s*" + _LITERAL + r"\s*\)")), r"(?i)^\.set\w*\s*\(\s*" + _LITERAL, 1), F.regexp_extract(F.regexp_substr("code", _pattern(r"\b", a, r"\s*=\s*" + _LITERAL + r"\s*;")), r"(?i)^\w+\s*=\s*" + _LITERAL, 1))
    value = F.when(literal.rlike("(?i)^(null|true|false)$"), F.lower(literal)).when(literal.rlike("^[\"']"), F.regexp_replace(F.substring(literal, 2, F.length(literal) - 2), r"\\(.)", "$1")).otherwise(literal)
    mapped = rows.where("_map").withColumns({"_e": earlier, "_v": value})
    over = mapped.where(F.col("_e").isNotNull() & F.col("_v").isNotNull()).join(defects.select("defect", "attribute", F.coalesce("actual", F.lit("null")).alias("_a")), ["defect", "attribute"]).where("_v = _a")
    place = F.struct("class_name", "method", F.col("line").isNull().alias("_last"), "line", "rank", "usage")
    overs = over.groupBy("defect", "attribute").agg(F.min(place).alias("over"))
    best = rows.groupBy("defect", "attribute").agg(
        F.min(F.when(F.col("usage").isin(*RISKS), at)).alias("risk"), F.min(F.when(F.col("_map"), at)).alias("mapping"), F.min(F.when((F.col("usage") == "COMMENTED_OUT") & F.col("_w"), at)).alias("comment")
    )
    d = defects.join(best, ["defect", "attribute"], "left").join(overs, ["defect", "attribute"], "left")
    lost = F.col("actual").isNull() & F.col("expected").isNotNull() & F.col("mapping").isNull()
    no_input = F.col("input").isNull() & F.col("expected").isNotNull()
    cases = [
        (no_input, F.lit("INPUT_MISSING_OR_NULL"), "HIGH", None), (F.col("risk").isNotNull(), F.col("risk.usage"), "HIGH", "risk"), (lost & F.col("comment").isNotNull(), F.lit("MISSING_MAPPING"), "HIGH", "comment"),
        (lost, F.lit("MISSING_MAPPING"), "MEDIUM", None), (F.col("over").isNotNull(), F.lit("VALUE_OVERWRITTEN"), "HIGH", "over"), (F.col("mapping").isNotNull(), F.lit("MAPPING_REVIEW_REQUIRED"), "MEDIUM", "mapping"),
    ]
    out = {"classification": F.lit("NO_DETERMINISTIC_DIVERGENCE_FOUND"), "confidence": F.lit("LOW")} | {c: F.lit(None) for c in ("class_name", "method", "line")}
    for holds, name, sure, where in reversed(cases):
        out["classification"], out["confidence"] = F.when(holds, name).otherwise(out["classification"]), F.when(holds, sure).otherwise(out["confidence"])
        for c in ("class_name", "method", "line"):
            out[c] = F.when(holds, F.col(f"{where}.{c}") if where else F.lit(None)).otherwise(out[c])
    return d.select("defect", "attribute", *[v.alias(k) for k, v in out.items()])

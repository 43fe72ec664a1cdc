"""Change impact, coverage and correlation. Explicit links are VERIFIED, overlaps are CANDIDATE; nothing promotes one to the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.store import scratch, stored, with_few


def classify_impact(items: DataFrame, direct: DataFrame, possible: DataFrame, key: str) -> DataFrame:
    """items with impact: DIRECTLY_AFFECTED if the key is in direct, POSSIBLY_AFFECTED if only in possible, else UNAFFECTED."""
    a = direct.select(key).distinct().withColumn("_direct", F.lit(True))
    b = possible.select(key).distinct().withColumn("_possible", F.lit(True))
    impact = F.when(F.col("_direct"), "DIRECTLY_AFFECTED").when(F.col("_possible"), "POSSIBLY_AFFECTED").otherwise("UNAFFECTED")
    return items.join(a, key, "left").join(b, key, "left").withColumn("impact", impact).drop("_direct", "_possible")


def reverse_rollup(uses: DataFrame, symbol: str, owners: dict[str, str], shared_from: int = 2) -> DataFrame:
    """One row per symbol: how many distinct owners of each kind use it, and whether `shared_from` or more of the first kind do."""
    first = next(iter(owners))
    out = uses.groupBy(symbol).agg(*[F.countDistinct(c).alias(n) for n, c in owners.items()])
    return out.withColumn("shared", F.col(first) >= shared_from)


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], days: float, score: Column | None = None, k: int = 3) -> DataFrame:
    """Pairs of left(id, ts) and right(other_id, other_ts) of equal keys at most so many days apart, the k best per id.

    Time is cut into buckets as wide as the interval; a row meets three buckets only, never a whole key.
    """
    width = days * 86400
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(micros(c) / 1e6 / width)
    a = left.withColumn("_b", F.explode(F.array(*[bucket("ts") + d for d in (-1, 0, 1)])))
    pairs = a.join(right.withColumn("_b", bucket("other_ts")), [*keys, "_b"]).drop("_b")
    apart = F.abs(micros("ts") - micros("other_ts")) / 86.4e9
    pairs = pairs.withColumn("days_apart", apart).where(F.col("days_apart") <= days).withColumn("score", F.lit(0.0) if score is None else score)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "days_apart", "other_id"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= k)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct items; two empty arrays have 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts", other_ts: str = "other_ts") -> DataFrame:
    """left with the columns of the last right row of its keys before or at its time; of right rows with one time the greatest counts.

    One sort of both sides, no join of pairs. Left columns keep their names whatever they are; right columns of a name that left has are
    an error, as in a join. Rows of a key with more than MANY are dealt into ranges of time of about equal size, if their times are numbers, dates or
    timestamps; each range is sorted by itself and takes the last right row of the ranges before from a table of one row for each range. Nulls in keys
    or times meet nothing.
    """
    added = [c for c in right.columns if c not in keys]
    ks = [f"k{i}" for i in range(len(keys))]
    a = left.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(ts).alias("t"), F.lit(1).alias("side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
    b = right.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(other_ts).alias("t"), F.lit(0).alias("side"), F.struct(*[F.col(f"`{c}`") for c in added]).alias("seen"))
    b = b.where(F.col("t").isNotNull() & F.concat(*[F.col(k).cast("string") for k in ks]).isNotNull()) if ks else b.where("t is not null")
    both = a.unionByName(b, allowMissingColumns=True)
    kind = both.schema["t"].dataType
    if not ks or not isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return _last_seen(both, ks, added)
    number = (F.col("t") if isinstance(kind, (T.NumericType, T.TimestampType)) else F.col("t").cast("timestamp")).cast("double")
    with scratch(left.sparkSession):
        large = stored(both.groupBy(*ks).agg(F.count("*").alias("n")).where(F.col("n") > MANY).select(*ks), "large-keys")
        if large.isEmpty():
            return _last_seen(both, ks, added)
        bounds = both.join(large, ks, "left_semi").groupBy(*ks).agg(F.percentile_approx(number, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_b"))
        large = stored(bounds, "large-keys", keep=True)
    placed = both.join(large, ks, "left").withColumn("_at", F.coalesce(F.size(F.filter("_b", lambda x: x < number)), F.lit(0))).drop("_b")
    ends = placed.where("side = 0").join(large.select(*ks), ks, "left_semi").groupBy(*ks, "_at").agg(F.max(F.struct("t", "seen"))["seen"].alias("end"))
    every = large.select(*ks, F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("_at")).join(ends, [*ks, "_at"], "left")
    before = Window.partitionBy(*ks).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("carried", F.last("end", ignorenulls=True).over(before)).select(*ks, "_at", "carried")
    return _last_seen(placed.join(carried, [*ks, "_at"], "left"), [*ks, "_at"], added, carried=True)


#: Rows of a key from which on its time is dealt into so many ranges.
MANY, RANGES = 1 << 20, 256


def _last_seen(both: DataFrame, by: list[str], added: list[str], carried: bool = False) -> DataFrame:
    """The rows of side 1 with the last `seen` of side 0 before or at their time, or what is carried into their range."""
    w = Window.partitionBy(*by).orderBy("t", "side", "seen").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("seen", ignorenulls=True).over(w)
    out = both.withColumn("last", F.coalesce(last, "carried") if carried else last).where("side = 1")
    return out.select("row.*", *[F.col(f"last.`{c}`").alias(c) for c in added])


def coverage(explicit: list[tuple[str, DataFrame]], tickets: DataFrame) -> DataFrame:
    """(ticket, covered_by, n_items, classification): tickets with their explicit links; earlier kinds of evidence come first; the others are gaps.

    explicit: (kind, links(item, ticket_list)) from strongest to weakest."""
    every = None
    for rank, (kind, links) in enumerate(explicit):
        one = links.select("item", F.explode("ticket_list").alias("ticket")).select("item", "ticket", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))
        every = one if every is None else every.unionByName(one)
    found = every.groupBy("ticket").agg(F.min(F.struct("rank", "kind"))["kind"].alias("covered_by"), F.countDistinct("item").alias("n_items"))
    out = tickets.select("ticket").distinct().join(found, "ticket", "left")
    return out.select("ticket", "covered_by", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.when(F.col("covered_by").isNull(), "GAP").otherwise("VERIFIED").alias("classification"))


def correlation_score(attributes: Column, code: Column, scenarios: Column, tests: Column, new_rules: Column, old_rules_only: Column, overlap: Column) -> Column:
    """0 to 100 from the counts of shared evidence of each kind; a kind without any adds nothing."""
    some = lambda n, base, each, most: F.when(n > 0, F.least(F.lit(most), base + each * n)).otherwise(0)
    total = some(attributes, 12, 4, 20) + some(code, 0, 2, 12) + some(scenarios, 5, 2, 15) + some(tests, 5, 2, 15) + 38 * new_rules - 25 * old_rules_only + F.least(F.lit(10), overlap)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def band(score: Column, high: int = 70, medium: int = 45) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys right lacks."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def collisions(configs: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """Configurations whose keys another scope has too, with n_others, the configurations of other scopes they collide with.

    Counts per key and scope meet counts per key, so a key that many share never becomes pairs.
    """
    own = configs.groupBy(*keys, scope).agg(F.count("*").alias("_own"))
    every = configs.groupBy(*keys).agg(F.count("*").alias("_all"))
    hit = own.join(every, keys).where("_all > _own").select(*keys, scope, (F.col("_all") - F.col("_own")).alias("n_others"))
    return configs.join(hit, [*keys, scope])


def value_rules(texts: DataFrame) -> DataFrame:
    """(doc_id, attribute, accepted, rejected): upper-case values that clauses "accept A, B" and "reject C" name for an attribute.

    A clause without an attribute (written `attribute name` or camelCase) goes with the last one before it.
    """
    clause = texts.select("doc_id", F.posexplode(F.split("text", r"[.;\n]+")).alias("pos", "clause"))
    named = F.nullif(F.regexp_extract("clause", r"\b([a-z]+[A-Z][A-Za-z0-9]*)\b", 1), F.lit(""))
    carried = F.last(named, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    part = lambda verbs: F.regexp_extract("clause", rf"(?i)\b(?:{verbs})s?\b((?:(?!\b(?:accept|allow|reject|deny)s?\b).)*)", 1)
    values = lambda c: F.regexp_extract_all(c, F.lit(r"\b[A-Z]{2,3}\b"), F.lit(0))
    rows = clause.select("doc_id", carried.alias("attribute"), values(part("accept|allow")).alias("a"), values(part("reject|deny")).alias("r")).where("attribute is not null")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return rows.groupBy("doc_id", "attribute").agg(every("a").alias("accepted"), every("r").alias("rejected")).where("size(accepted) + size(rejected) > 0")


#: Verbs that accept or reject, words between a verb and its values, and words that are no values.
_ACCEPTS, _REJECTS = "accept|allow|permit|support", "reject|deny|disallow"
_INSTRUCTION = (
    rf"(?i)\b((?:continue\s+(?:to\s+)?(?:{_ACCEPTS}|{_REJECTS})|(?:{_ACCEPTS}|{_REJECTS})(?:ing|ed)?|excluding|exclude))"
    r"\s+(?:only\s+|the\s+values?\s+|values?\s+|codes?\s+|for\s+)?([A-Z]{2,}(?:\s*(?:,|and|or)\s*[A-Z]{2,})*)"
)
_NO_VALUES = ("ONLY", "VALUES", "VALUE", "CODE", "CODES", "THE", "FOR", "AND", "OR")


def value_instructions(documents: DataFrame, attributes: DataFrame) -> DataFrame:
    """(doc_id, attribute, polarity, value, pos): values that a document's clauses ACCEPT or REJECT for an attribute, each once a clause.

    documents(doc_id, text), attributes(doc_id, attribute) that count in a document. Clauses end at . ; or a line. A clause speaks of the attributes that it names as whole words, case
    aside, or, if it names none, of those that the last clause before it named. Values are words of two letters or more after a verb, between commas, and, or; in capitals."""
    clause = documents.select("doc_id", F.posexplode(F.split("text", r"[.;\n]+")).alias("pos", "clause")).where("trim(clause) <> ''")
    words = clause.select("doc_id", "pos", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("clause"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("_w"))
    asked = attributes.select("doc_id", "attribute", F.lower("attribute").alias("_w")).where("_w <> ''").distinct()
    # Spark takes exploded words for as small as the rows that they come from, and would broadcast them
    named = words.hint("merge").join(asked, ["doc_id", "_w"]).groupBy("doc_id", "pos").agg(F.collect_set("attribute").alias("_named"))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spoken = clause.hint("merge").join(named, ["doc_id", "pos"], "left").withColumn("_of", F.last("_named", ignorenulls=True).over(upto)).where("_of is not null")
    told = F.transform(F.regexp_extract_all("clause", F.lit(_INSTRUCTION), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, _INSTRUCTION, 1).alias("verb"), F.regexp_extract(x, _INSTRUCTION, 2).alias("values")))
    each = spoken.select("doc_id", "pos", "_of", F.explode(told).alias("i")).select("doc_id", "pos", F.explode("_of").alias("attribute"), "i")
    polarity = F.when(F.col("i.verb").rlike("(?i)reject|deny|disallow|exclud"), "REJECT").otherwise("ACCEPT")
    values = each.select("doc_id", "attribute", polarity.alias("polarity"), F.explode(F.split(F.upper("i.values"), r"\s*(?:,|\bAND\b|\bOR\b)\s*")).alias("value"), "pos")
    return values.where(~F.col("value").isin(*_NO_VALUES) & (F.col("value") != "")).distinct()


def instruction_conflicts(instructions: DataFrame) -> DataFrame:
    """(doc_id, attribute, values, accepting, rejecting): values of value_instructions that are both accepted and rejected, sorted, with the clauses that say so."""
    clauses = lambda p: F.array_sort(F.collect_set(F.when(F.col("polarity") == p, F.col("pos"))))
    each = instructions.groupBy("doc_id", "attribute", "value").agg(clauses("ACCEPT").alias("a"), clauses("REJECT").alias("r")).where("size(a) > 0 and size(r) > 0")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return each.groupBy("doc_id", "attribute").agg(F.array_sort(F.collect_list("value")).alias("values"), every("a").alias("accepting"), every("r").alias("rejecting"))


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """Rules that both accept and reject a value."""
    return rules.withColumn("contradicted", F.array_intersect("accepted", "rejected")).where("size(contradicted) > 0")


def threshold_mismatches(stated: DataFrame, applied: DataFrame) -> DataFrame:
    """Conditions (lhs, op, threshold) that documents state and code applies otherwise."""
    s = stated.select("doc_id", F.lower("lhs").alias("lhs"), F.col("op").alias("stated_op"), F.col("threshold").alias("stated_threshold"))
    c = applied.select(F.lower("lhs").alias("lhs"), F.col("op").alias("code_op"), F.col("threshold").alias("code_threshold")).distinct()
    return with_few(s, c, "lhs").where("stated_op <> code_op or stated_threshold <> code_threshold").distinct()


def percentiles(samples: DataFrame, group: str, value: str, steps: int = 40) -> DataFrame:
    """Rows, median, and the value at position floor(0.95 (n - 1)) of each group.

    Rows are counted by range of values first, `steps` ranges for each power of ten; only the ranges that hold a wanted position
    are ordered, so a hot group is spread over its ranges.
    """
    v = F.col(value).cast("double")
    mag = F.floor(F.log10(F.abs(v)) * steps) + 1_000_000  # above 0 for every number there is
    rng = F.when(v == 0, 0).when(v < 0, -mag).otherwise(mag).cast("long")
    own = samples.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), v.alias("v"), rng.alias("r"))
    counted = own.groupBy("g", "r").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("before", F.sum("c").over(upto) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy("g")))
    n = F.col("n")
    wanted = placed.select("g", "r", "before", "c", "n", F.explode(F.array(F.floor((n - 1) / 2), F.ceil((n - 1) / 2), F.floor(0.95 * (n - 1)))).alias("at"))
    wanted = wanted.where("at >= before and at < before + c").select("g", "r", "before", "n", "at").distinct()
    ranges = wanted.select(F.col("g").alias("wg"), F.col("r").alias("wr")).distinct()
    inside = own.join(ranges, F.col("g").eqNullSafe(F.col("wg")) & (F.col("r") == F.col("wr")), "left_semi").groupBy("g", "r", "v").agg(F.count("*").alias("m"))
    within = Window.partitionBy("g", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("upto", F.sum("m").over(within)).select(F.col("g").alias("ig"), F.col("r").alias("ir"), "v", "upto")
    found = wanted.join(ranked, F.col("g").eqNullSafe(F.col("ig")) & (F.col("r") == F.col("ir"))).where(F.col("before") + F.col("upto") > F.col("at"))
    found = found.groupBy("g", "n", "at").agg(F.min("v").alias("v"))
    at = lambda position: F.min(F.when(F.col("at") == position, F.col("v")))
    return found.groupBy(F.col("g").alias(group), "n").agg(((at(F.floor((n - 1) / 2)) + at(F.ceil((n - 1) / 2))) / 2).alias("p50"), at(F.floor(0.95 * (n - 1))).alias("p95"))

"""Column builders for text: tokenisers, normal forms, extraction. Everything stays in the JVM; nulls give null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKET = r"\b[A-Z][A-Z0-9]+-[0-9]+\b"


def search_tokens(text: Column) -> Column:
    """Tokens of the retrieval corpus: runs of letters, digits and _ . / : - in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_./:-]+"), F.lit(0))


def word_tokens(text: Column, least: int = 2, stop: tuple[str, ...] = ()) -> Column:
    """Distinct tokens of letters, digits and underscores, each also without its underscores; short and stop words go."""
    raw = F.split(F.lower(text), "[^a-z0-9_]+")
    every = F.flatten(F.transform(raw, lambda t: F.array(t, F.replace(t, F.lit("_"), F.lit("")))))
    kept = F.filter(F.array_distinct(every), lambda t: F.length(t) >= least)
    return F.array_except(kept, F.array(*map(F.lit, stop))) if stop else kept


def camel_tokens(text: Column, least: int = 3, whole: bool = True) -> Column:
    """Distinct lower-case parts of camelCase names, and the names themselves if wanted."""
    parts = F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    every = F.concat(parts, F.split(F.lower(text), "[^a-z0-9]+")) if whole else parts
    return F.filter(F.array_distinct(every), lambda t: F.length(t) >= least)


def compact(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def accessor_attribute(method: Column) -> Column:
    """The attribute behind getX, setX or isX; other names give null."""
    name = F.regexp_extract(method, "^(?:get|set|is)([A-Z].*)$", 1)
    return F.when(name != "", F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20)))


def domain_token(class_name: Column, roles: tuple[str, ...]) -> Column:
    """The first word of a class name in lower case, after its role suffixes, in any number and case, are taken off; a name of roles alone stays whole.

    roles: the suffixes that count, for example those of a project's own naming rules."""
    each = "|".join(roles)
    bare = F.regexp_replace(class_name, f"(?i)(?:{each})+$", "") if roles else class_name
    return F.lower(F.regexp_extract(F.when(bare == "", class_name).otherwise(bare), "^([A-Z]?[a-z0-9]+|[A-Z]+)", 1))


def without_section(text: Column, heading: str) -> Column:
    """The text less the section under a heading line, up to the next numbered heading or the end."""
    return F.regexp_replace(text, rf"(?ims)^[ \t]*(?:\d+[.)][ \t]*)?{heading}[ \t]*:?[ \t]*$.*?(?=^[ \t]*\d+[.)][ \t]|\z)", "")


def is_test_path(path: Column) -> Column:
    """Whether a file path lies in a folder of tests or names a test class."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(r"(^|/)tests?/|tests?\.[a-z0-9]+$")


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def month_releases(text: Column) -> Column:
    """Distinct releases named by a month and a year, as "September 2026", in the order of their first mention."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b((?:{MONTHS})\s+\d{{4}})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.initcap(F.regexp_replace(m, r"\s+", " "))))


def utc_timestamp(text: Column) -> Column:
    """An ISO time as a timestamp: with an offset as stated, without one in UTC (the session's zone aside); anything else null."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, F.trim(text)).otherwise(F.concat(F.trim(text), F.lit("Z"))))


def change_priority(change: Column, body: Column) -> Column:
    """ACCESSOR_ONLY for a getter or setter, VALIDATION if the body compares or throws, else RELATED."""
    return F.when(change.rlike("^(get|set|is)[A-Z]"), "ACCESSOR_ONLY").when(body.rlike(r"\b(if|throw|assert)\b|[<>]=?|==|!="), "VALIDATION").otherwise("RELATED")


def paragraph_chunks(text: Column, size: int = 900, overlap: int = 120) -> Column:
    """struct(number, chunk): a text cut at blank lines, then lines, then spaces where pieces are longer than size, and merged greedily up to size;
    a chunk begins with the last pieces of the one before, as many as fit into overlap. A word over size is cut every size characters."""
    pieces = lambda parts, pattern: F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.split(p, pattern))))
    cut = F.split(F.coalesce(text, F.lit("")), r"(?<=\n\n)")
    for pattern in (r"(?<=\n)", "(?<= )"):
        cut = pieces(cut, pattern)
    starts = lambda p: F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1)), F.lit(size))
    cut = F.flatten(F.transform(cut, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.transform(starts(p), lambda s: F.substring(p, s, F.lit(size))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"))
    joined = lambda held: F.array_join(held, "")

    def tail(held: Column, more: Column) -> Column:
        """The last pieces of held that fit into overlap, and into a chunk together with what comes."""
        room = F.least(F.lit(overlap), size - F.length(more))
        kept = F.aggregate(F.reverse(held), F.struct(F.array().cast("array<string>").alias("keep"), F.lit(True).alias("open")), lambda a, p: F.when(a["open"] & (F.length(joined(a["keep"])) + F.length(p) <= room), F.struct(F.concat(F.array(p), a["keep"]).alias("keep"), F.lit(True).alias("open"))).otherwise(F.struct(a["keep"].alias("keep"), F.lit(False).alias("open"))))
        return kept["keep"]

    def step(a: Column, p: Column) -> Column:
        fits = F.length(joined(a["held"])) + F.length(p) <= size
        full = F.struct(F.concat(a["done"], F.array(joined(a["held"]))).alias("done"), F.concat(tail(a["held"], p), F.array(p)).alias("held"))
        return F.when(fits, F.struct(a["done"].alias("done"), F.concat(a["held"], F.array(p)).alias("held"))).otherwise(full)

    every = F.aggregate(cut, start, step, lambda a: F.concat(a["done"], F.array(joined(a["held"]))))
    return F.transform(F.filter(every, lambda c: F.trim(c) != ""), lambda c, i: F.struct(i.alias("number"), F.trim(c).alias("chunk")))


def version_key(version: Column) -> Column:
    """An array that orders versions naturally: digits by value, the rest by lower-case text."""
    parts = F.regexp_extract_all(version, F.lit(r"\d+|\D+"), F.lit(0))
    keyed = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p)))
    return F.when(F.substring(version, 1, 1).rlike(r"\d"), F.concat(F.array(F.lit("")), keyed)).otherwise(keyed)


def document_id(kind: Column, key: Column) -> Column:
    """40 hex digits that name a row of a kind."""
    return F.substring(F.sha2(F.concat_ws(":", F.upper(kind), key), 256), 1, 40)


def endpoint_key(url: Column) -> Column:
    """A path without scheme, host and query, single slashes, variables as {} and no slash at the end."""
    path = F.regexp_replace(F.split(url, r"\?")[0], r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"\{[^/}]*\}", "{}")
    return F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)


def scope_key(path: Column) -> Column:
    """A project path as one spelling: forward slashes, lower case, no slash at the end."""
    return F.regexp_replace(F.lower(F.replace(F.trim(path), F.lit("\\"), F.lit("/"))), "/+$", "")


def source_kind(path: Column, stated: Column | None = None) -> Column:
    """XML, JSON, DB, KAFKA or UNKNOWN by the look of a source path; a stated kind wins."""
    lower = F.lower(F.coalesce(path, F.lit("")))
    guess = (
        F.when(lower.rlike(r"^(xpath:|/{1,2}\w)|\.xml"), "XML")
        .when(lower.rlike(r"^(json:|jsonpath:|\$\.)|\.json"), "JSON")
        .when(lower.rlike(r"^(db:|table:|column:)|^\w+\.\w+\.\w+$"), "DB")
        .when(lower.rlike("topic|kafka"), "KAFKA")
        .otherwise("UNKNOWN")
    )
    return guess if stated is None else F.coalesce(F.nullif(F.upper(F.trim(stated)), F.lit("")), guess)


def source_key(path: Column) -> Column:
    """A source path without its kind prefix, for equality."""
    return F.regexp_replace(F.lower(F.trim(path)), r"^(xpath|json|jsonpath|db|table|column):\s*", "")


def owner_and_attribute(target: Column) -> Column:
    """struct(owner, attribute) of Owner.attr or Owner#attr; without a separator owner is null."""
    name = F.replace(target, F.lit("#"), F.lit("."))
    owner = F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1)
    return F.struct(F.nullif(owner, F.lit("")).alias("owner"), F.substring_index(name, ".", -1).alias("attribute"))


def family_and_version(file_name: Column) -> Column:
    """struct(family, version) of a file name that ends in a version such as _V2.1 before its extension."""
    stem = F.regexp_replace(file_name, r"\.[A-Za-z0-9]{1,5}$", "")
    version = F.regexp_extract(stem, r"(?i)[_\- ]?(v\d+(?:\.\d+)*)$", 1)
    family = F.regexp_replace(stem, r"(?i)[_\- ]?v\d+(?:\.\d+)*$", "")
    return F.struct(F.upper(family).alias("family"), F.nullif(F.upper(version), F.lit("")).alias("version"))


def before_section(text: Column, heading: str) -> Column:
    """The text before a line that begins with a heading."""
    return F.split(text, rf"(?i)\n\s*{heading}\s*:", 2)[0]


def tickets(text: Column) -> Column:
    """Distinct ticket keys in the order of their first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TICKET), F.lit(0)))


def listed(value: Column) -> Column:
    """Items of a JSON list of strings, or of text delimited by commas, semicolons or white space; blanks go."""
    return F.filter(F.coalesce(F.from_json(value, "array<string>"), F.split(F.trim(value), r"[,;\s]+")), lambda x: x != "")


def mentions(text: Column, term: Column) -> Column:
    """Whether text holds term between characters that are neither letters, digits nor underscores; case does not matter."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "), F.lit(" "))
    return F.contains(padded, F.concat(F.lit(" "), F.lower(term), F.lit(" ")))


def snippet(text: Column, tokens: Column, before: int = 70, after: int = 230) -> Column:
    """The surroundings of the first token found; without one, the beginning."""
    places = F.filter(F.transform(tokens, lambda t: F.position(t, F.lower(text))), lambda at: at > 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - before, F.lit(1))
    return F.substring(text, start, F.lit(before + after))


def fixed_chunks(text: Column, step: int = 5000, size: int = 5500) -> Column:
    """struct(number, chunk) for windows that overlap by size - step characters; blank ones go."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda s, i: F.struct(i.alias("number"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))
    return F.filter(cut, lambda c: F.trim(c["chunk"]) != "")


def conditions(text: Column) -> Column:
    """struct(lhs, op, threshold) of each comparison of a name with a number."""
    pattern = r"([A-Za-z_][A-Za-z0-9_.]*)\s*(<=|>=|==|!=|<|>)\s*(-?\d+(?:\.\d+)?)"
    part = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("lhs"), part(2).alias("op"), part(3).alias("threshold"))
    return F.transform(zipped, lambda z: F.struct(z["lhs"].alias("lhs"), z["op"].alias("op"), z["threshold"].cast("double").alias("threshold")))


def boundary_values(threshold: Column, op: Column) -> Column:
    """struct(value, expected) for the threshold, a step below, a step above and null; a step is 0.01, or a thousandth over 1000."""
    step = F.when(F.abs(threshold) > 1000, F.abs(threshold) * 0.001).otherwise(F.lit(0.01))

    def holds(value: Column) -> Column:
        return (
            F.when(op == "<", value < threshold)
            .when(op == "<=", value <= threshold)
            .when(op == ">", value > threshold)
            .when(op == ">=", value >= threshold)
            .when(op == "==", value == threshold)
            .otherwise(value != threshold)
        )

    values = [threshold - step, threshold, threshold + step]
    return F.array(*[F.struct(v.alias("value"), holds(v).alias("expected")) for v in values], F.struct(F.lit(None).cast("double").alias("value"), F.lit(False).alias("expected")))

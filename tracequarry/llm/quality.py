"""Quality rules as a bitmask ledger (operator 4); DataFrame functions only.

Every rule is evaluated once per document; the ledger stores the measurements and one bit per failed rule. Policies are
versioned masks over those bits, so that a new policy, or the effect of leaving a rule out, needs no text again.

Nulls: a null text is measured like an empty one; other columns are not read. Empty texts fail the word count and nothing
else. Repeated rows get a ledger row each. Columns with the name of a measurement are replaced. Empty table: empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm._store import fresh

MEASURES = ("n_words", "n_repeat_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_capitals", "n_exclamations")
SPACES = r"[\x20\x09-\x0D]+"

#: Rules in the order of their bits: name and when a document fails.
RULES: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("few_words", lambda: F.col("n_words") < 10),
    ("repeated_words", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    ("duplicate_lines", lambda: (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
    ("capitals", lambda: (F.col("n_words") >= 10) & (100 * F.col("n_capitals") > 60 * F.col("word_chars"))),
    ("exclamations", lambda: (F.col("n_words") >= 10) & (2 * F.col("n_exclamations") > F.col("n_words"))),
    ("word_length", lambda: (F.col("n_words") >= 10) & ((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 30 * F.col("n_words")))),
)

#: Versions of the policy: the rules that reject a document.
POLICIES: dict[int, tuple[str, ...]] = {1: ("few_words", "repeated_words"), 2: tuple(name for name, _ in RULES)}


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in names)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for each row."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, k: int = 5) -> Column:
    """How many words of the array stand in a window of k words that occurs twice or more in it."""

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(at, j + 1) - x, F.lit(k))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)

    def twice(pairs: Column) -> Column:
        same = lambda e, other: F.coalesce(F.get(pairs, other)["key"] == e["key"], F.lit(False))
        found = F.filter(pairs, lambda e, j: same(e, j - 1) | same(e, j + 1))
        return _let(F.sort_array(F.transform(found, lambda e: e["at"])), covered)

    def of_keys(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(_let(pairs, twice))

    def of_words(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when(F.size(w) <= k, F.lit(0).cast("long")).otherwise(_let(keys, of_keys))

    return _let(words, of_words)


def ledger(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with the measurements and `failed`, the bits of the failed rules."""
    t = F.coalesce(F.col(text), F.lit(""))  # `text` has no name of a measurement
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    words = F.filter(F.split(t, SPACES), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    plain = documents.drop(*MEASURES, "failed")
    of_words, of_lines = fresh(plain, "by_words"), fresh(plain, "by_lines")
    measured = plain.withColumns(
        {
            of_words: by_words,
            of_lines: by_lines,
            "word_chars": F.length(F.regexp_replace(t, SPACES, "")).cast("long"),
            "n_symbols": count(r"[#*$%&|<>]"),
            "n_capitals": count(r"\p{Lu}"),
            "n_exclamations": count("!"),
        }
    )
    measured = measured.select("*", f"{of_words}.*", f"{of_lines}.*").drop(of_words, of_lines)
    bits = [F.when(fails(), 1 << k).otherwise(0) for k, (_, fails) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("int"))


def kept(version: int, failed: str = "failed") -> Column:
    """Whether the policy of that version keeps a document with those bits."""
    return F.col(failed).bitwiseAND(mask(POLICIES[version])) == 0


def ablation(stored_ledger: DataFrame, version: int) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that would be kept without it.

    The ledger shrinks to one row per pattern of bits before the rules are laid over it.
    """
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).alias("bit")) for k, (name, _) in enumerate(RULES) if name in POLICIES[version]])
    patterns = stored_ledger.groupBy(F.col("failed").bitwiseAND(mask(POLICIES[version])).alias("failed")).agg(F.count("*").alias("n"))
    laid = patterns.select("failed", "n", F.explode(rules).alias("r")).select("failed", "n", "r.rule", "r.bit")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return laid.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_or(F.when(hit, F.col("failed")).otherwise(0)).alias("fails_with"),
    )

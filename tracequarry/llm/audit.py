"""Audit of how filters interact in every order that they can be applied in (operator 13).

Each document is read once and becomes a mask of the filters that it fails. Documents of one part with one mask are a cell, and from
the cells alone a Gray-code walk over all subsets of filters stores how many documents, good ones and toxic ones survive each
subset: one filter is switched at a time, a counter for each cell says how many active filters it fails, and only cells whose
counter leaves or reaches zero change what survives. What a step of an order removes is the difference of two stored states.

Copies are texts with equal SHA-256; the filter on copies fails all but those of the least doc_id, over all parts.

Nulls: a null text is empty, a null part is the empty string, a null doc_id is no smaller than any and has no label, so that it never
fails as a copy. Repeated rows count each by itself, and as none has a smaller doc_id they are no copies of each other. Of several
labels of one doc_id any that is 1 counts. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm._store import stored

#: Filters on the measurements n_words, n_distinct, n_capitals, n_chars and on the text `t`: when a document fails.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 100,
    "B": lambda: 100 * F.col("n_distinct") < 80 * F.col("n_words"),
    "C": lambda: 100 * F.col("n_capitals") > 10 * F.col("n_chars"),
    "D": lambda: F.col("t").rlike("[#$%&*|]"),
}
#: The filter on copies.
COPIES = "E"
MEASURES = ("n", "good", "toxic")


def measured(documents: DataFrame, part: str, filters: dict[str, Callable[[], Column]]) -> DataFrame:
    """digest, doc_id, part and bits (of the failed filters, in their order) of every row."""
    plain = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    words = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    by_words = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct")))[0]
    counted = plain.withColumns({"w": by_words, "n_capitals": F.regexp_count("t", F.lit("[A-Z]")).cast("long"), "n_chars": F.length("t").cast("long")}).select("*", "w.*")
    bits = F.lit(0)
    for k, fails in enumerate(filters.values()):
        bits = bits.bitwiseOR(F.when(fails(), 1 << k).otherwise(0))
    return counted.select(F.unhex(F.sha2("t", 256)).alias("digest"), "doc_id", "part", bits.cast("int").alias("bits"))


def cells(documents: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Callable[[], Column]] = FILTERS) -> DataFrame:
    """(part, cell, n, good, toxic): documents of a part by their mask of failed filters; the bit after those of `filters` is for copies.

    Copies of one text meet as sums by (text, part, mask, labels), which are combined before they are sent, so a text that a third of all
    rows have is a few rows for each task."""
    rows = measured(documents, part, filters).groupBy("digest", "doc_id", "part", "bits").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    texts = stored(
        marked.groupBy("digest", "part", "bits", "good", "toxic").agg(
            F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_unknown")
        ),
        "audit-texts",
    )
    least = texts.groupBy("digest").agg(F.min("first").alias("least"))
    alone = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0) + F.col("n_unknown")
    split = texts.join(least, "digest").withColumn("alone", alone)
    both = F.array(F.struct(F.col("bits").alias("cell"), F.col("alone").alias("n")), F.struct(F.col("bits").bitwiseOR(1 << len(filters)).alias("cell"), (F.col("n") - F.col("alone")).alias("n")))
    each = split.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "good", "toxic", "c.cell", "c.n").where("n > 0")
    return each.groupBy("part", "cell").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def walk(cells: np.ndarray) -> np.ndarray:
    """What survives each subset of filters, of cells[part, mask, measure]: states[part, subset, measure], in Gray-code order of visits."""
    size = cells.shape[1]
    failing = np.zeros(size, np.int64)  # how many active filters each mask fails
    running, state = cells.sum(axis=1), 0
    states = np.zeros_like(cells)
    states[:, 0] = running
    for visit in range(1, size):
        toggled = (visit & -visit).bit_length() - 1
        state ^= 1 << toggled
        fails = np.arange(size) >> toggled & 1 == 1
        if state >> toggled & 1:
            running = running - cells[:, fails & (failing == 0)].sum(axis=1)
            failing[fails] += 1
        else:
            failing[fails] -= 1
            running = running + cells[:, fails & (failing == 0)].sum(axis=1)
        states[:, state] = running
    return states


def states(cells: DataFrame, n_filters: int) -> DataFrame:
    """(part, n, good, toxic): of each part an array of all subsets' survivors, placed by the subset's bits."""
    size = 1 << n_filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.zeros((batch.num_rows, size, len(MEASURES)), np.int64)
            for row, found in enumerate(batch.column("cells").to_pylist()):
                for cell in found:
                    table[row, cell["cell"]] = [cell[m] for m in MEASURES]
            done = walk(table)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch.column("part"), *[pa.ListArray.from_arrays(offsets, pa.array(done[:, :, m].reshape(-1))) for m in range(len(MEASURES))]], ["part", *MEASURES])

    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("cell", *MEASURES)).alias("cells"))  # at most one for each subset
    return by_part.mapInArrow(run, "part string, " + ", ".join(f"{m} array<long>" for m in MEASURES))


def steps(states: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters and step, all from differences of stored states."""
    k = len(names)
    orders = list(itertools.permutations(range(k)))
    of = np.array(orders).reshape(-1)  # the filter of each step
    after = np.bitwise_or.accumulate(1 << np.array(orders), axis=1).reshape(-1)
    before, every = after ^ (1 << of), (1 << k) - 1
    order, step = np.repeat(["".join(names[f] for f in o) for o in orders], k), np.tile(np.arange(1, k + 1), len(orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, good, toxic = (batch.column(m)[row].values.to_numpy() for m in MEASURES)
                removed = n[before] - n[after]
                failing, only = n[0] - n[1 << np.arange(k)], n[every ^ (1 << np.arange(k))] - n[every]
                shapley = np.bincount(of, weights=removed, minlength=k) if removed.sum() < 1 << 52 else np.array([removed[of == f].sum() for f in range(k)])
                values = [n[after], removed, failing[of] - removed, only[of], good[before] - good[after], toxic[before] - toxic[after], shapley.astype(np.int64)[of]]
                part = pa.array([batch.column("part")[row].as_py()] * len(of), pa.string())
                yield pa.RecordBatch.from_arrays([part, pa.array(order.tolist()), pa.array(step.astype(np.int32)), *map(pa.array, values)], ["part", "filter_order", "step", *COUNTS])

    return states.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of FILTERS and COPIES by part. labels(doc_id, quality, toxic)."""
    table = stored(states(cells(documents, labels, part), len(FILTERS) + 1), "audit-states")
    return steps(table, "".join(FILTERS) + COPIES)

"""Document fingerprints by a threshold-scaled sketch (operator 10).

A sketch holds every hash of a shingle (five lower-cased words) below a fixed fraction of the hash range, so sketches of
very unequal documents compare, and the sketch of a union is the union of sketches. A text with words but no hash below
the fraction keeps its least hash; it goes again when a union has one below.

A fingerprint is "f8:" (f, and one hash in 8) and the ascending 64-bit hashes, little-endian, in Base64.

Nulls: a null text is empty; an empty text has an empty sketch; two empty sketches have likeness 1, an empty and another
0. A text of one to four words is one shingle. Rows go by doc_id from high to low, nulls last, then by a hash of the text;
equal rows follow each other. One row alone is its own next. Empty table: no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracequarry.llm import _words
from tracequarry.llm._store import size_of

#: One hash in so many is kept.
SCALE = 8
SHINGLE = 5


def _sketches(column: pa.Array, scale: int) -> list[np.ndarray]:
    words = _words.Words(column, lower=True)
    grams, rows = words.grams(SHINGLE, whole=True)
    below = grams < np.uint64((1 << 64) // scale)
    kept = np.concatenate(([0], np.cumsum(below)))[rows]
    values, ends = _words.unique_in_rows(grams[below], kept)
    out = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    for i in np.flatnonzero((np.diff(kept) == 0) & (np.diff(rows) > 0)):
        out[i] = grams[rows[i] : rows[i + 1]].min(keepdims=True)
    return out


def _text(sketch: np.ndarray, scale: int) -> str:
    return f"f{scale}:" + base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    """The scale and hashes of a fingerprint."""
    head, _, body = fingerprint.partition(":")
    return int(head[1:]), np.frombuffer(base64.b64decode(body), "<u8")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = _shared(a, b)
    return 1.0 if not len(a) and not len(b) else both / (len(a) + len(b) - both)


def likeness(a: str, b: str) -> float:
    """Estimated resemblance (shared of all shingles) of two fingerprints."""
    return _likeness(read(a)[1], read(b)[1])


def containment(a: str, b: str) -> float:
    """Estimated part of the shingles of a that b has too; of an empty a, 1."""
    x, y = read(a)[1], read(b)[1]
    return _shared(x, y) / len(x) if len(x) else 1.0


def merged(prints: list[str]) -> str:
    """The fingerprint of all shingles of several fingerprints of one scale."""
    scale = read(prints[0])[0]
    every = np.unique(np.concatenate([read(p)[1] for p in prints]))
    below = every[every < np.uint64((1 << 64) // scale)]
    return _text(below if len(below) else every[:1], scale)


def fingerprinted(documents: DataFrame, scale: int = SCALE, text: str = "text") -> DataFrame:
    """documents with their `fingerprint`; one pass, no shuffle."""
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch, text):
                prints = pa.array([_text(s, scale) for s in _sketches(part.column(text), scale)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, prints], [*columns, "fingerprint"])

    return documents.mapInArrow(run, documents.withColumn("fingerprint", F.lit("")).schema)


#: Ranges of rows that are sorted on their own: one row for each comes to the driver.
RANGES = 20_000


def with_next(documents: DataFrame, target: int = 1 << 26) -> DataFrame:
    """(place, last, doc_id, text) so dealt and sorted that each row is followed by the next document in descending doc_id.

    Only ids are sorted to find where the ranges begin; then texts move once, to their range. The first row of a range also
    goes to the end of the range before (last = true), and that of the first range to the end of the last. doc_id may be of any
    type that orders. There are at most RANGES ranges, larger ones beyond that, which their sort spills.
    """
    spark = documents.sparkSession
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    n = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size_of(documents) // target))
    ids = own.select("doc_id", "tie").repartitionByRange(n, *order).withColumn("range", F.spark_partition_id())
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.bitwise_not("tie").alias("tie")))
    heads = ids.groupBy("range").agg(first.alias("head")).collect()
    key = lambda doc_id, tie: (doc_id is not None, 0 if doc_id is None else doc_id, tie)
    bounds = sorted(key(r["head"]["doc_id"], r["head"]["tie"]) for r in heads)  # ascending: the last range comes first

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = set(bounds)
        for batch in batches:
            keys = [key(i, ~t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), strict=True)]
            place = [bisect_left(bounds, k) for k in keys]
            head = [row for row, k in enumerate(keys) if k in where]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array([False] * len(keys)), *batch.columns], ["place", "last", *batch.schema.names])
            if head:
                again = batch.take(pa.array(head))
                before = pa.array([(place[row] + 1) % len(bounds) for row in head], pa.int32())
                yield pa.RecordBatch.from_arrays([before, pa.array([True] * len(head)), *again.columns], ["place", "last", *batch.schema.names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    dealt = own.mapInArrow(deal, f"place int, last boolean, doc_id {kind}, text string, tie long")
    return dealt.repartition(n, "place").sortWithinPartitions("place", "last", *order).select("place", "last", "doc_id", "text")


def edited_fingerprints(documents: DataFrame, scale: int = SCALE) -> DataFrame:
    """Each row's fingerprint, that of its text with the second half replaced by the start of the next document, and likenesses."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    arrow_kind = to_arrow_type(documents.schema["doc_id"].dataType)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(rows: list, doc_ids: list) -> pa.RecordBatch:
        """rows: (text, sketch, next text, next sketch)"""
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, _, after, _ in rows]
        changed = _sketches(pa.array(edited, pa.large_string()), scale)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids, arrow_kind),
                pa.array([len(t) for t, *_ in rows], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([_text(s, scale) for _, s, _, _ in rows], pa.string()),
                pa.array([_text(c, scale) for c in changed], pa.string()),
                pa.array([_likeness(s, c) for (_, s, _, _), c in zip(rows, changed, strict=True)], pa.float64()),
                pa.array([_likeness(s, after) for _, s, _, after in rows], pa.float64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in _words.slices(batch):
                texts = part.column("text").to_pylist()
                rows, doc_ids = [], []
                for place, last, doc_id, text, sketch in zip(part.column("place").to_pylist(), part.column("last").to_pylist(), part.column("doc_id").to_pylist(), texts, _sketches(part.column("text"), scale), strict=True):
                    if held and held[0] == place:
                        rows.append((held[2], held[3], text, sketch))
                        doc_ids.append(held[1])
                    held = None if last else (place, doc_id, text, sketch)
                if rows:
                    yield compare(rows, doc_ids)

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(documents).mapInArrow(run, schema)

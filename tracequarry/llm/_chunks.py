"""Documents in chunks, and values that recur over all chunks.

A chunk is a bounded run of whole documents, stored compressed under a number of its own. To learn which of its values (hashes,
phrases) occur twice or more anywhere, each chunk sends every distinct value once, as a row, and gets back those that recur. So
rows grow with the documents and with nothing else, and no value has more rows than there are chunks, however often it occurs:
at most one of the hundreds of thousands that a chunk sends is the same value.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm import _words


def chunked(documents: DataFrame, text: str = "text", most: int = _words.SLICE) -> DataFrame:
    """One row per chunk: chunk, payload (all texts, compressed), sizes (bytes of each text) and rows (each row's other columns)."""
    others = [f for f in documents.schema.fields if f.name != text]
    rows_type = T.ArrayType(T.StructType(others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in _words.slices(batch, text, most):
                data, offsets = _words.texts(part.column(text))
                fields = [part.schema.field(f.name) for f in others]
                rows = pa.StructArray.from_arrays([part.column(f.name) for f in others], fields=fields)
                rows = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([random.getrandbits(63)]), pa.array([press.compress(data.tobytes())]), pa.array([np.diff(offsets)], pa.list_(pa.int64())), rows],
                    ["chunk", "payload", "sizes", "rows"],
                )

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("rows", rows_type)])
    return documents.select(text, *[f"`{f.name}`" for f in others]).mapInArrow(run, schema)


def texts_of(payload: bytes, sizes: np.ndarray) -> pa.Array:
    """The texts of a chunk as an Arrow column."""
    data = zstandard.ZstdDecompressor().decompress(payload)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def counted(sent: DataFrame) -> DataFrame:
    """sent(chunk, value, twice, ...) with `total`, 2 or more if two chunks sent the value, or one that has it twice."""
    return sent.withColumn("total", F.sum(F.when(F.col("twice"), 2).otherwise(1)).over(Window.partitionBy("value")))


def recurring(sent: DataFrame) -> DataFrame:
    """The rows (chunk, value) of sent whose value recurs."""
    return counted(sent).where("total > 1").select("chunk", "value")


def per_chunk(chunks: DataFrame, answers: DataFrame):
    """Each chunk together with its answers, for applyInArrow."""
    return chunks.groupBy("chunk").cogroup(answers.withColumnRenamed("chunk", "of").groupBy("of"))


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the values are among some."""
    if not len(some):
        return np.zeros(len(values), bool)
    some = np.sort(some)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values

"""Removal of repeated passages with repeated-phrase automata (operator 7).

Every window of `window` words holds a phrase of eight words that is picked by its content (the least hash), so equal windows
pick equal phrases. The picked phrases of all documents are counted, and those that recur anywhere are confirmed. The confirmed
phrases are sharded by the chunks of documents that asked for them: each chunk gets the words of those that it picked itself, compiles them into
one Aho-Corasick automaton, and streams its own documents through it, which locates their occurrences there. A document meets no phrase that
its chunk did not pick; equal windows pick equal phrases, so none that may repeat is missed. Around an occurrence stand
the windows that may repeat; their counts over all documents then say exactly which do, and the words that they cover go.

Words are runs of bytes other than space and 0x09-0x0D. Phrases are told apart by 21 bits of the hash of each of their words,
windows by 64-bit hashes of their words.

Nulls: a null text has no words and comes back empty. Texts shorter than a window lose nothing. Repeated rows repeat each
other's windows. Empty table: no rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.llm import _chunks, _words
from tracequarry.llm._store import scratch, stored

#: Words in a phrase, or half a window if that is less.
PHRASE = 8
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A word is three letters of an alphabet of its own for each place, so that phrases are found at whole words only and a node has few edges.
_PLACES = np.array([0, 128, 256], np.uint16)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def automaton_of(phrases: list[bytes]) -> ahocorasick.Automaton:
    """The automaton of phrases, each the letters of its words."""
    automaton = ahocorasick.Automaton()
    for phrase in phrases:
        letters = np.frombuffer(phrase, np.uint8).reshape(-1, 3) + _PLACES
        automaton.add_word(letters.astype("<u2").tobytes().decode("utf-16-le"), 0)
    automaton.make_automaton()
    return automaton


class Passages:
    """The words and windows of the texts of a chunk."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.words = w = _words.Words(texts, lower=False)
        self.window, self.phrase = window, min(PHRASE, (window + 1) // 2)
        self.ends = np.repeat(w.rows[1:], w.counts())  # of each word's text
        self.valid = np.arange(len(w.hashes)) + window <= self.ends
        code = (w.hashes >> np.uint64(43)).astype(np.int64)
        self.letters = np.stack([code >> 14, code >> 7 & 127, code & 127], axis=1).astype(np.uint8)

    def picked(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct phrases that windows pick, and which of them are picked at two places or more."""
        n, k = len(self.valid), self.phrase
        if not self.valid.any():
            return [], np.zeros(0, bool)
        at = np.arange(n - k + 1)
        hashes = _words.polynomial(self.words.hashes, at, at + k)
        width = self.window - k + 1
        least = _sliding(np.where(at + k <= self.ends[: len(at)], hashes, _MAX), width, np.minimum)
        of_windows = np.where(self.valid[: len(least)], least, np.uint64(0))
        edge = np.zeros(width - 1, np.uint64)
        greatest = _sliding(np.concatenate((edge, of_windows, edge)), width, np.maximum)
        own = np.flatnonzero(greatest == hashes)  # a phrase is picked if it is the least of a window around it
        _, first, counts = np.unique(hashes[own], return_index=True, return_counts=True)
        raw = self.letters[own[first][:, None] + np.arange(k)].tobytes()
        return [raw[i : i + 3 * k] for i in range(0, len(raw), 3 * k)], counts >= 2

    def located(self, automaton: ahocorasick.Automaton) -> np.ndarray:
        """The word at which each occurrence of a phrase begins, found by streaming all texts through the automaton."""
        if not len(automaton) or not len(self.ends):
            return np.zeros(0, np.int64)
        stream = (self.letters + _PLACES).astype("<u2").tobytes().decode("utf-16-le")
        starts = (np.fromiter((end for end, _ in automaton.iter(stream)), np.int64) + 1) // 3 - self.phrase
        return starts[starts + self.phrase <= self.ends[starts]]

    def candidates(self, starts: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a phrase beginning at one of starts."""
        edge = np.zeros(len(self.valid) + 1, np.int64)
        np.add.at(edge, np.maximum(starts - (self.window - self.phrase), 0), 1)
        np.add.at(edge, starts + 1, -1)
        return np.flatnonzero((np.cumsum(edge)[:-1] > 0) & self.valid)

    def hashes(self, windows: np.ndarray) -> np.ndarray:
        return _words.polynomial(self.words.hashes, windows, windows + self.window).astype(np.int64)

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """Which words stand in one of the windows."""
        edge = np.zeros(len(self.valid) + 1, np.int64)
        np.add.at(edge, windows, 1)
        np.add.at(edge, windows + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def _load(payload: bytes, sizes: np.ndarray, window: int) -> Passages:
    return Passages(_chunks.texts_of(payload, sizes), window)


def _of(left: pa.Table, window: int) -> tuple[int, Passages]:
    return left.column("chunk")[0].as_py(), _load(left.column("payload")[0].as_py(), left.column("sizes")[0].values.to_numpy(), window)


def without_repeats(documents: DataFrame, window: int = 50, words_only: bool = False, results: bool = True) -> DataFrame:
    """documents with `text` less every word covered by a repeated window, and n_words, n_removed and removed (the ranges of
    bytes taken out of the UTF-8 text). words_only: the kept words joined by one space; else the text as it was between the cuts. Results
    replace columns of the same name; without `results` only the columns of documents come back."""
    with scratch(documents.sparkSession):
        chunks = stored(_chunks.chunked(documents), "repeat-chunks", keep=True)
    return _cut(documents, chunks, window, words_only, results)


def _cut(documents: DataFrame, chunks: DataFrame, window: int, words_only: bool, results: bool) -> DataFrame:
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, twice = _load(batch.column("payload")[row].as_py(), batch.column("sizes")[row].values.to_numpy(), window).picked()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column("chunk")[row].as_py())), pa.array(own, pa.binary()), pa.array(twice)], ["chunk", "value", "twice"])

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        """The windows around occurrences, and a row for the chunk itself with marks, the bits of where they start."""
        names = ["chunk", "value", "twice", "marks"]
        starts = np.zeros(0, np.int64)
        if left.num_rows:
            chunk, passages = _of(left, window)
            starts = passages.candidates(passages.located(automaton_of(right.column("value").to_pylist())))
        if not len(starts):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.bool_()), pa.array([], pa.binary())], names)
        bits = np.zeros(len(passages.valid), bool)
        bits[starts] = True
        hashes, often = np.unique(passages.hashes(starts), return_counts=True)
        n = len(hashes)
        values = np.append(hashes, chunk)  # the chunk's own row counts twice and comes back; a task that runs again makes the same row
        marks = pa.array([None] * n + [np.packbits(bits).tobytes()], pa.binary())
        return pa.table([pa.array(np.full(n + 1, chunk)), pa.array(values), pa.array(np.append(often >= 2, True)), marks], names)

    order = documents.columns
    slim = chunks.select("chunk", "payload", "sizes")
    confirmed = _chunks.recurring(slim.mapInArrow(phrases, "chunk long, value binary, twice boolean"))
    found = _chunks.per_chunk(slim, confirmed).applyInArrow(windows, "chunk long, value long, twice boolean, marks binary")
    # windows around an occurrence mostly recur, so those that do not are sent back
    single = _chunks.counted(found).where("total = 1 or marks is not null").select("chunk", "value", "marks")
    inner = T.StructType([f for f in documents.schema.fields if f.name != "text"])
    schema = T.StructType(
        [T.StructField("row", inner), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
        + [T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    )

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        _, passages = _of(left, window)
        w = passages.words
        own = pc.is_valid(right.column("marks"))
        starts = np.zeros(0, np.int64)
        if right.num_rows:
            starts = np.flatnonzero(np.unpackbits(np.frombuffer(right.column("marks").filter(own)[0].as_py(), np.uint8), count=len(passages.valid)))
        alone = right.column("value").filter(pc.invert(own)).to_numpy()
        gone = passages.covered(starts[~_chunks.among(passages.hashes(starts), alone)])
        data = w.data.tobytes()
        texts, removed, ranges = [], [], []
        for row, (a, b) in enumerate(zip(w.rows, w.rows[1:], strict=False)):
            base, end = int(w.offsets[row]), int(w.offsets[row + 1])
            out = gone[a:b]
            removed.append(int(out.sum()))
            if words_only:
                keep = np.flatnonzero(~out) + a
                texts.append(b" ".join([data[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)]))
            step = np.diff(np.concatenate(([0], out.astype(np.int8), [0])))
            begins, stops = np.flatnonzero(step > 0) + a, np.flatnonzero(step < 0) + a
            spans = [(int(w.starts[s]), int(w.starts[e]) if e < b else end) for s, e in zip(begins, stops, strict=True)]
            ranges.append([{"start": s - base, "end": e - base} for s, e in spans])
            if not words_only:
                edges = [base, *[x for span in spans for x in span], end]
                texts.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
        rows = left.column("rows").combine_chunks().flatten()
        kept = pa.array([t.decode() for t in texts], pa.string())
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([rows, kept, pa.array(w.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(ranges, spans_type)], ["row", "text", "n_words", "n_removed", "removed"])

    out = _chunks.per_chunk(chunks, single).applyInArrow(cut, schema)
    names = ["n_words", "n_removed", "removed"] if results else []
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in order if c not in names]
    return out.select(*columns, *names)

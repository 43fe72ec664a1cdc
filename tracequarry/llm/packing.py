"""Packing documents into sequences of a fixed number of tokens (operator 6).

Documents become token ids and an end id; only those over the capacity are cut. How many pieces there are of each length,
at most `capacity` numbers, is all that the packing looks at: Martello and Toth's dominance fixes small sets of lengths
that no other set can beat, best fit in decreasing order packs the rest, and the plan is a table of runs (length, ranks,
sequences, offset). Pieces get a rank among those of their length and join their run.

Nulls: a null text is one end id; a null doc_id is a value like others. Empty texts are one end id. Rows with one doc_id
are packed on their own, and `row` tells them apart. Empty table: no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.llm import _words
from tracequarry.llm._store import parts, stored

_encoders: dict[str, "Encoder"] = {}
#: A space inside a run of white space, where the tokenizer's own split of words differs from one before each space.
_INSIDE = re.compile(r"\s (?=\s|\Z)")
_BYTE = np.arange(256)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) & (_BYTE < 128)
_OTHER, _SEEN, _BLANK, _WIDE = (_BYTE < 128) & ~_LETTER, (_BYTE > 32) & (_BYTE < 127), _BYTE <= 32, _BYTE >= 128


def _runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin to begin + size - 1 of each run, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)


class _Memory:
    """Ids of words by the hash of the word, hashes in ascending order."""

    def __init__(self) -> None:
        self.hashes, self.begin, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are here, and the places of those."""
        at = np.searchsorted(self.hashes, hashes)
        here = at < len(self.hashes)
        here[here] = self.hashes[at[here]] == hashes[here]
        return here, at[here]

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Words that are not here yet, their hashes in ascending order."""
        at = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, at, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes, self.hashes = np.insert(self.sizes, at, sizes), np.insert(self.hashes, at, hashes)
        self.ids = np.concatenate([self.ids, ids])


class Encoder:
    """Token ids of texts, as bytes of little-endian unsigned 32-bit numbers, the same as encode(text, add_special_tokens=False) gives.

    Of a byte-level vocabulary the tokenizer never merges across the start of a space that begins a word, from an ASCII letter to
    another ASCII character, nor after a line break that stands alone between visible characters. So the distinct words that lie between are looked up
    by a 64-bit hash in a bounded memory; the new ones of a batch are encoded once, all in a few calls, with a line break after each
    that tells their ids apart. Texts with other runs of spaces or with a special token's string are encoded whole, and so are all
    texts if the file has another pre-tokenizer, a normalizer, another model, truncation or padding.
    """

    #: Words in each of the two generations of the memory, and the bytes of new words in a call.
    most, call = 500_000, 1 << 16

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before, model = parts.get("pre_tokenizer") or {}, parts["model"]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        plain = plain and not any(parts.get(x) for x in ("normalizer", "truncation", "padding"))
        self.by_words = bool(plain and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges"))
        added = [re.escape(t["content"]) for t in parts.get("added_tokens", [])]
        self.odd, self.added = re.compile("|".join([_INSIDE.pattern, *added])), [a.encode() for a in added]
        if self.by_words:
            line = self.tokenizer.encode("\n", add_special_tokens=False).ids
            self.by_words, self.line = len(line) == 1, line[0] if line else 0
        self.known, self.older = _Memory(), _Memory()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words data[start:end] has, and all ids, word by word."""
        own = starts + (data[starts] == 32)  # a space that begins a word is part of it
        total = lambda of: np.concatenate(([0], np.cumsum(of[data], dtype=np.int32)))
        blank, wide = total(_BLANK), total(_WIDE)
        plain = (own < ends) & (blank[ends] == blank[own])
        text = lambda k: data[starts[k] : ends[k]].tobytes().decode()
        for k in np.flatnonzero(plain & (wide[ends] > wide[own])).tolist():
            word = text(k)
            pieces = word.split()
            plain[k] = len(pieces) == 1 and len(pieces[0]) == len(word) - (word[0] == " ")
        sizes = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # words and their ids
        left = np.flatnonzero(plain)
        lengths = ends[left] - starts[left] + 1
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // self.call)) + 1
        for part, size in zip(np.split(left, cuts), np.split(lengths, cuts), strict=True):
            if not len(part):
                continue
            joined = data[np.minimum(_runs(starts[part], size), len(data) - 1)]
            joined[np.cumsum(size) - 1] = 10
            ids = self._encode([joined.tobytes().decode()])[0]
            lines = np.flatnonzero(ids == self.line)
            if len(lines) != len(part):
                plain[part] = False
                continue
            sizes[part] = np.diff(lines, prepend=-1) - 1
            found.append((part, ids[ids != self.line]))
        others = np.flatnonzero(~plain)
        for k, ids in zip(others.tolist(), self._encode([text(k) for k in others.tolist()]), strict=True):
            sizes[k] = len(ids)
            found.append((np.array([k]), ids))
        if not found:
            return sizes, np.zeros(0, "<u4")
        order = np.concatenate([part for part, _ in found])
        begin = np.empty(len(starts), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return sizes, np.concatenate([ids for _, ids in found])[_runs(begin, sizes)]

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are encoded whole. The pattern is searched only where a space follows a byte that may end white space, or an added token stands."""
        raw = data.tobytes()
        may = [1 + np.flatnonzero((data[1:] == 32) & (_BLANK | _WIDE)[data[:-1]])]
        may += [np.array([m.start() for m in re.finditer(token, raw)], np.int64) for token in self.added]
        odd = np.zeros(len(offsets) - 1, bool)
        for k in np.unique(np.searchsorted(offsets, np.concatenate(may), "right") - 1).tolist():
            odd[k] = bool(self.odd.search(raw[offsets[k] : offsets[k + 1]].decode()))
        return odd

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a column. Each distinct word of the column is looked up once."""
        if not self.by_words:
            return [ids.tobytes() for ids in self._encode(pc.fill_null(texts, "").to_pylist())]
        data, offsets = _words.texts(texts)
        n = len(offsets) - 1
        if not len(data):
            return [b""] * n
        odd = self._odd(data, offsets)
        letter, seen = _LETTER[data], _SEEN[data]
        begins = data == 32
        begins[1:] |= letter[:-1] & _OTHER[data[1:]]
        begins[2:] |= seen[:-2] & (data[1:-1] == 10) & seen[2:]
        for k in np.flatnonzero(odd).tolist():
            begins[offsets[k] : offsets[k + 1]] = False
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes, first, inverse = np.unique(_words.polynomial(_words._CODE[data], starts, ends), return_index=True, return_inverse=True)
        if len(self.known.hashes) > self.most:
            self.known, self.older = _Memory(), self.known
        known, at = self.known.places(hashes)
        older, at_older = self.older.places(hashes)
        older &= ~known
        at_older = at_older[older[self.older.places(hashes)[0]]]
        new = ~known & ~older
        begin, sizes = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        begin[known], sizes[known] = self.known.begin[at], self.known.sizes[at]
        begin[older], sizes[older] = len(self.known.ids) + self.older.begin[at_older], self.older.sizes[at_older]
        sizes[new], ids = self._new(data, starts[first[new]], ends[first[new]])
        begin[new] = len(self.known.ids) + len(self.older.ids) + np.cumsum(sizes[new]) - sizes[new]
        every = np.concatenate([self.known.ids, self.older.ids, ids])
        keep = ~known & (ends[first] - starts[first] <= 64)
        self.known.add(hashes[keep], sizes[keep], every[_runs(begin[keep], sizes[keep])])
        many = sizes[inverse]
        upto = np.concatenate(([0], np.cumsum(many)))
        cuts = upto[np.searchsorted(starts, offsets)].tolist()
        ids = every[_runs(begin[inverse], many)]
        return [ids[cuts[i] : cuts[i + 1]].tobytes() for i in range(n)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """The pieces of each row (doc_id, text): row (a number of its own), piece, start, length, ids_crc32 and, if wanted, ids (little-endian unsigned 32-bit)."""
    tail = np.array([end], "<u4").tobytes()
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in _words.slices(batch, most=1 << 20):
                rows, numbers, starts, lengths, crcs, kept = [], [], [], [], [], []
                for row, ids in enumerate(enc.encode(part.column("text"))):
                    ids += tail
                    n = len(ids) // 4
                    view = memoryview(ids)
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(row)
                        numbers.append(number)
                        starts.append(a)
                        lengths.append(b - a)
                        crcs.append(zlib.crc32(view[4 * a : 4 * b]))
                        if keep_ids:
                            kept.append(bytes(view[4 * a : 4 * b]))
                own = pa.array(rows, pa.int64())
                columns = [part.column("doc_id").take(own), part.column("row").take(own), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))]
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if keep_ids else []), names + ["ids"] * keep_ids)

    return documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset): pieces of one length, one in each of successive sequences."""
    left = dict(sorted(((length, n) for length, n in counts.items() if n), reverse=True))
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    # dominance: the best partner of a length is fixed if nothing else can fill a sequence better
    for length in list(left):
        while left.get(length):
            room = capacity - length
            fits = [x for x in left if x <= room and (x != length or left[length] > 1)]
            if not fits:
                n = left[length]
                put(length, n, sequences, 0)
                sequences += n
                break
            partner = fits[0]
            small = [x for x in list(left)[::-1][:3] for _ in range(min(3, left[x] - (x == length)))]
            only_one = len(small) < 2 or small[0] + small[1] > room
            if partner != room and not only_one:
                break
            n = left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, n, sequences, 0)
            put(partner, n, sequences, length)
            sequences += n

    # best fit, longest first, on groups of sequences with equal room
    rooms: dict[int, list[tuple[int, int]]] = {}
    for length in list(left):
        while left.get(length):
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                n = -(-left[length] // (capacity // length))
                rooms[capacity] = [(sequences, n)]
                sequences += n
                room = capacity
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = room // length
            full = min(n, left[length] // each)
            if full:
                for k in range(each):
                    put(length, full, first, capacity - room + k * length)
                rooms.setdefault(room - each * length, []).append((first, full))
            rest = left.get(length, 0)
            if full < n and rest:
                for k in range(rest):
                    put(length, 1, first + full, capacity - room + k * length)
                rooms.setdefault(room - rest * length, []).append((first + full, 1))
                full += 1
            if full < n:
                rooms.setdefault(room, []).append((first + full, n - full))
    return runs


def packed(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """cut, a stored table of pieces, with sequence_id and offset. Pieces of one length take their ranks by doc_id, piece, CRC and row."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length, capacity at most
    runs = spark.createDataFrame(plan_runs(counts, capacity) or [(0, 0, 0, 0, 0)], "_length long, _rank long, _n long, _first long, _offset long")
    bucketed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts(cut, 1 << 22, 64, "ids_crc32"))))
    ahead = F.sum("_m").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_m")).select("length", "_bucket", F.coalesce(ahead, F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32", "row"))
    ranked = bucketed.withColumn("_own", within).join(base, ["length", "_bucket"]).withColumn("_r", F.col("_base") + F.col("_own") - 1)
    # runs has at most capacity x log2(pieces) rows or so: each length is dealt in runs that halve what is left
    at = (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_n"))
    placed = ranked.join(F.broadcast(runs), at)
    return placed.select(*cut.columns, (F.col("_first") + F.col("_r") - F.col("_rank")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack(documents: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    return packed(stored(pieces(documents, tokenizer, capacity, end, keep_ids), "pieces", keep=True), capacity)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence, from packed pieces that kept their ids; a sequence holds at most `capacity` ids."""
    each = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(each, F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"]))
    return packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))

"""Language-model scores from a lattice of subwords (operator 3).

A text is its lower-cased words, each a "▁" and its characters, and an end. A word's probability is the sum over all ways
to cut it into pieces of an existing vocabulary, found by a forward recursion in log space, and the document's is the
product over its words and end. A piece with "▁" begins a word, or the text ends (one distribution); what follows a first
piece is another piece or the word's end (a second one). Three weightings of the pieces are scored on the same lattice:

* `score`: the vocabulary's own scores as a prior of `prior_count` pieces, and the counts that forward and backward sums expect
  in the words of the training rows;
* `vocabulary_score`: the vocabulary's own scores alone;
* `mixed_score`: as `score`, but a training word as a whole is one more way to say it; words have their training counts less an
  absolute discount, whose mass goes to the pieces.

Characters outside the vocabulary are their UTF-8 bytes, each a piece.

Nulls: a null text is empty and has only its end; a null doc_id counts as the text "" for the split. Repeated rows are
scored, and if in training counted, each. Without training rows the prior alone weighs the pieces. Empty table: no rows.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm import _words
from tracequarry.llm._store import stored

#: Bytes of text in a chunk; a chunk's words are looked up together.
CHUNK = 1 << 23
#: Words' characters are worked on in blocks of about so many cells.
CELLS = 1 << 17
#: Words with more characters are worked on one by one.
LONG = 256
_LOW = np.log(1e-300)
#: Leading bits of a hash in the look-up table.
_LEADING = 18
_SHIFT = np.uint64(64 - _LEADING)


@dataclass
class Vocabulary:
    """Pieces with log weights: hashes ascending, log probabilities alike; and those of the 256 bytes. begins: whether "▁" is a piece.

    first: where the hashes with given leading bits begin, so that a look-up ends at once for most keys.
    """

    hashes: np.ndarray
    first: np.ndarray
    log_p: np.ndarray
    byte_log_p: np.ndarray
    longest: int
    begins: bool


def read_vocabulary(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of a SentencePiece model: its pieces, their scores, and the index of each of the 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    at = np.zeros(256, np.int64)
    for i, piece in enumerate(pieces):
        if model.is_byte(i):
            at[int(piece[1:-1], 16)] = i
    usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(len(pieces))]
    scores = np.array([model.get_score(i) if ok else np.nan for i, ok in enumerate(usable)])
    bytes_ = {int(i) for i in at}
    return [p if ok and i not in bytes_ else "" for i, (p, ok) in enumerate(zip(pieces, usable, strict=True))], scores, at


def prior(scores: np.ndarray, pieces: list[str]) -> np.ndarray:
    """Probabilities from a vocabulary's scores. Scores of merges are ranks (0, -1, -2, ...), which stand for a Zipf law; others are log probabilities."""
    known = scores[[bool(p) for p in pieces]]
    ranks = len(known) and float(known.min()) < -1000
    weight = 1 / (10 - scores) if ranks else np.exp(scores)
    weight[[not p for p in pieces]] = np.nanmin(weight)
    weight[np.isnan(scores)] = 0
    return weight / weight.sum()


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def vocabulary(pieces: list[str], p: np.ndarray, byte_at: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The lookup table for pieces with probabilities p, and the number of the piece behind each of its rows."""
    at = np.array([i for i, piece in enumerate(pieces) if piece])
    lengths = np.array([len(pieces[i]) for i in at])
    ends = np.cumsum(lengths)
    hashes = _words.polynomial(_words.mix(_codes([pieces[i] for i in at])), ends - lengths, ends)
    order = np.argsort(hashes)
    with np.errstate(divide="ignore"):
        first = np.searchsorted(hashes[order] >> _SHIFT, np.arange((1 << _LEADING) + 1, dtype=np.uint64))
        return Vocabulary(hashes[order], first, np.log(p[at])[order], np.log(p[byte_at]), int(lengths.max()), "▁" in pieces), at[order]


def _blocks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length each time: their numbers and the codes of their characters, as rows. Long words come alone."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for some in np.array_split(at, len(at) if n > LONG else max(1, len(at) * int(n) // CELLS)):
            yield some, _codes([words[i] for i in some]).reshape(len(some), n)


def _found(keys: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys are in the vocabulary, and their rows there."""
    lead = (keys >> _SHIFT).astype(np.int64)
    at, end = voc.first[lead], voc.first[lead + 1]
    some = np.flatnonzero(at < end)
    keys, at, end = keys[some], at[some], end[some]
    hits, rows = [], []
    while len(some):
        same = voc.hashes[at] == keys
        hits.append(some[same])
        rows.append(at[same])
        left = ~same & (at + 1 < end)
        some, keys, at, end = some[left], keys[left], at[left] + 1, end[left]
    return (np.concatenate(hits), np.concatenate(rows)) if hits else (some, at)


@dataclass
class Lattice:
    """Words of one length with the pieces found in them.

    edges: (start, end, words, rows of the vocabulary), by ascending end; all words that have a piece at [start, end) are one edge,
    but of a long word, which comes alone, each edge is a row of flat arrays.
    """

    words: int
    length: int
    codes: np.ndarray
    edges: list[tuple[int, int, np.ndarray, np.ndarray]]
    flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None


def lattice(codes: np.ndarray, voc: Vocabulary) -> Lattice:
    rows, n = codes.shape
    up, down = _words._power(_words._ODD, n, "up"), _words._power(_words._INVERSE, n + 1, "down")
    total = np.zeros((n + 1, rows), np.uint64)
    np.cumsum((_words.mix(codes) * up).T, axis=0, out=total[1:])
    if n > LONG:
        found = []
        for size in range(1, voc.longest + 1):
            i = np.arange(n - size + 1)
            hit, at = _found(_words.mix((total[i + size, 0] - total[i, 0]) * down[i] + np.uint64(size)), voc)
            found.append((i[hit], i[hit] + size, at))
        i, j, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(j, kind="stable")
        return Lattice(rows, n, codes, [], (i[order], j[order], at[order]))
    edges = []
    for j in range(1, n + 1):
        for i in range(max(0, j - voc.longest), j):
            hit, at = _found(_words.mix((total[j] - total[i]) * down[i] + np.uint64(j - i)), voc)
            if len(hit):
                edges.append((i, j, hit, at))
    return Lattice(rows, n, codes, edges, None)


def _fallback(codes: np.ndarray, voc: Vocabulary, byte_log_p: np.ndarray) -> np.ndarray:
    """The log probability of each character as bytes. The "▁" that begins a word is only said as bytes if no piece says it."""
    own, back = np.unique(codes, return_inverse=True)
    logs = [sum(byte_log_p[b] for b in chr(int(c) - 1).encode("utf-8", "surrogatepass")) for c in own]
    out = np.array(logs)[back].reshape(codes.shape)
    if voc.begins:
        out[:, 0] = -np.inf
    return out


def forward(grid: Lattice, voc: Vocabulary, log_p: np.ndarray, byte_log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log sums over all segmentations of each prefix of each word, and the characters' fallback."""
    n = grid.length
    a = np.full((grid.words, n + 1), -np.inf)
    a[:, 0] = 0
    single = _fallback(grid.codes, voc, byte_log_p)
    if grid.flat is not None:
        i, j, at = grid.flat
        edge, w = np.searchsorted(j, np.arange(n + 2)), log_p[at]
        row = a[0]
        for end in range(1, n + 1):
            some = slice(edge[end], edge[end + 1])
            row[end] = np.logaddexp(row[end - 1] + single[0, end - 1], np.logaddexp.reduce(row[i[some]] + w[some], initial=-np.inf))
        return a, single
    k = 0
    for j in range(1, n + 1):
        a[:, j] = a[:, j - 1] + single[:, j - 1]
        while k < len(grid.edges) and grid.edges[k][1] == j:
            i, _, hit, at = grid.edges[k]
            a[hit, j] = np.logaddexp(a[hit, j], a[hit, i] + log_p[at])
            k += 1
    return a, single


def log_marginals(words: list[str], voc: Vocabulary, *others: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Natural logs of the summed probability of all segmentations of each word (with its "▁"), by voc's weights and by each other weighting."""
    weightings = [(voc.log_p, voc.byte_log_p), *others]
    out = [np.zeros(len(words)) for _ in weightings]
    for at, codes in _blocks(["▁" + w for w in words]):
        grid = lattice(codes, voc)
        for values, (log_p, byte_log_p) in zip(out, weightings, strict=True):
            values[at] = forward(grid, voc, log_p, byte_log_p)[0][:, -1]
    return out


def expected(words: list[str], times: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Expected counts of the vocabulary's rows in the words, each so many times."""
    counts = np.zeros(len(voc.hashes))
    for own, codes in _blocks(["▁" + w for w in words]):
        grid, n = lattice(codes, voc), codes.shape[1]
        a, single = forward(grid, voc, voc.log_p, voc.byte_log_p)
        b = np.full((grid.words, n + 1), -np.inf)
        b[:, n] = 0
        if grid.flat is not None:
            i, j, at = grid.flat
            order = np.argsort(i, kind="stable")
            edge, w, ends = np.searchsorted(i[order], np.arange(n + 2)), voc.log_p[at][order], j[order]
            row = b[0]
            for start in range(n - 1, -1, -1):
                some = slice(edge[start], edge[start + 1])
                row[start] = np.logaddexp(row[start + 1] + single[0, start], np.logaddexp.reduce(row[ends[some]] + w[some], initial=-np.inf))
            share = np.exp(np.maximum(a[0, i] + voc.log_p[at] + row[j] - a[0, n], _LOW)) * times[own[0]]
            counts += np.bincount(at, share, len(counts))
            continue
        k = len(grid.edges) - 1
        for j in range(n, 0, -1):
            b[:, j - 1] = np.logaddexp(b[:, j - 1], b[:, j] + single[:, j - 1])
            while k >= 0 and grid.edges[k][1] == j:
                i, _, hit, at = grid.edges[k]
                step = voc.log_p[at] + b[hit, j]
                b[hit, i] = np.logaddexp(b[hit, i], step)
                counts += np.bincount(at, np.exp(np.maximum(a[hit, i] + step - a[hit, n], _LOW)) * times[own[hit]], len(counts))
                k -= 1
    return counts


def _packed(tokens: np.ndarray) -> bytes:
    """Numbers as compressed bytes, of two bytes each where they fit; the last byte says how wide."""
    wide = 4 if len(tokens) and tokens.max() > 0xFFFF else 2
    return zstandard.ZstdCompressor(level=3).compress(tokens.astype(f"<u{wide}").tobytes()) + bytes([wide])


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[:-1]), f"<u{packed[-1]}").astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _chunks(documents: DataFrame, folds: int, fold: int) -> DataFrame:
    """One row per chunk of documents: doc_ids, held_out, n (words of each), tokens (numbers of words in `words`), words, and counts of the words in training rows."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch, most=CHUNK):
                words = _words.Words(part.column("text"), lower=True)
                held = np.array([zlib.crc32(str("" if i is None else i).encode()) % folds == fold for i in part.column("doc_id").to_pylist()])
                own, first, tokens = np.unique(words.hashes, return_index=True, return_inverse=True)
                size = np.bincount(tokens, minlength=len(own))
                rank = np.argsort(-size, kind="stable")
                place = np.empty(len(own), np.int64)
                place[rank] = np.arange(len(own))
                tokens, first = place[tokens], first[rank]
                train = np.bincount(tokens[~held[words.of()]], minlength=len(own))
                lowered = _words._LOWER.astype(np.uint8)[words.data].tobytes()
                names = [lowered[a:b].decode() for a, b in zip(words.starts[first], words.ends[first], strict=True)]
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([random.getrandbits(63)]), one(part.column("doc_id").to_pylist(), part.schema.field("doc_id").type), one(held, pa.bool_()), one(words.counts(), pa.int64()), pa.array([_packed(tokens)]), one(names, pa.string()), one(train, pa.int64())],
                    ["chunk", "doc_ids", "held_out", "n", "tokens", "words", "train"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"chunk long, doc_ids array<{kind}>, held_out array<boolean>, n array<long>, tokens binary, words array<string>, train array<long>")


@dataclass
class Model:
    """What is learned from the training rows: two weightings of one vocabulary, and what mixes its words in."""

    voc: Vocabulary
    own: tuple[np.ndarray, np.ndarray]  # the weighting by the vocabulary's scores alone
    stops: tuple[float, float]  # log of a word's end by either weighting
    end_p: float
    events: float
    discount: float
    spelled: float  # the share of words that the mix spells, by pieces

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each word by either weighting."""
        learned, own = log_marginals(words, self.voc, self.own)
        return (learned + self.stops[0]) / math.log(10), (own + self.stops[1]) / math.log(10)

    def mixed(self, log_p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of words by the mix, from their log10 by pieces and their training counts."""
        whole = np.maximum(counts - self.discount, 0) / self.events
        return np.log10(whole + 10**log_p * (self.spelled / (1 - self.end_p)))


def weighted(pieces: list[str], counts: np.ndarray, end_p: float, byte_at: np.ndarray) -> tuple[Vocabulary, np.ndarray, float]:
    """The vocabulary with pieces weighed by counts, the piece behind each row, and the log probability that a word ends after a piece."""
    opens = np.array([piece.startswith("▁") for piece in pieces])
    heads = counts[opens].sum()
    inner = counts[~opens].sum() + heads  # each word has one head and one end
    voc, at = vocabulary(pieces, np.where(opens, counts / heads * (1 - end_p), counts / inner), byte_at)
    return voc, at, math.log(heads / inner)


def scored(documents: DataFrame, vocabulary_path: str, folds: int = 5, fold: int = 1, prior_count: float = 1000.0, rounds: int = 2) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id as text) modulo folds is not fold.

    prior_count: how many pieces the prior counts for; rounds: of expectation and weighting. What goes through the driver is one row of totals and one row per
    piece of the vocabulary.
    """
    pieces, scores, byte_at = read_vocabulary(vocabulary_path)
    start = prior(scores, pieces)
    chunks = stored(_chunks(documents, folds, fold), "lm-chunks")
    counted = chunks.select(F.explode(F.arrays_zip("words", "train")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.train").alias("c"))
    counted = stored(counted, "lm-words")
    docs_in = F.size(F.filter("held_out", lambda h: ~h))
    ends = chunks.agg(F.coalesce(F.sum(docs_in), F.lit(0)).alias("ends")).first()["ends"]
    totals = counted.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("n", F.col("c")), ("v", (F.col("c") > 0).cast("long")), ("once", (F.col("c") == 1).cast("long")), ("twice", (F.col("c") == 2).cast("long")))]).first()

    n, v = totals["n"], totals["v"]
    events = n + max(ends, 0.5)
    end_p = max(ends, 0.5) / (events if n else 1.0)
    training = counted.where("c > 0")
    own, piece_at, own_stop = weighted(pieces, start, end_p, byte_at)
    model, stop = own, own_stop
    for _ in range(rounds):

        def weigh(batches: Iterator[pa.RecordBatch], model: Vocabulary = model, piece_at: np.ndarray = piece_at) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(model.hashes))
            for batch in _gathered(batches):
                total += expected(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64), model)
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece_at[hit]), pa.array(total[hit])], ["piece", "count"])

        counts = prior_count * start
        for row in training.mapInArrow(weigh, "piece long, count double").groupBy("piece").agg(F.sum("count").alias("count")).collect():  # one row per piece
            counts[row["piece"]] += row["count"]
        model, piece_at, stop = weighted(pieces, counts, end_p, byte_at)
    discount = totals["once"] / (totals["once"] + 2 * totals["twice"]) if totals["once"] and totals["twice"] else 0.5
    spelled = discount * v / events if v else 1 - end_p
    learned = Model(model, (own.log_p, own.byte_log_p), (stop, own_stop), end_p, events if v else 1.0, discount, spelled)
    tokens_in, kinds = n + ends, v + (1 if ends else 0)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            by_pieces, by_scores = learned.words(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(by_pieces.astype(np.float32)), pa.array(by_scores.astype(np.float32))], ["word", "c", "by_pieces", "by_scores"])

    valued = stored(counted.select("word", "c").mapInArrow(value, "word string, c long, by_pieces float, by_scores float"), "lm-values")
    # words are told apart by 64-bit hashes here, and their values travel as single precision; a chunk asks for a word once, so no
    # word has more rows than there are chunks
    wanted = chunks.select("chunk", F.posexplode("words").alias("at", "word")).select("chunk", "at", F.xxhash64("word").alias("h"))
    answers = wanted.join(valued.select(F.xxhash64("word").alias("h"), "c", "by_pieces", "by_scores"), "h").select(F.col("chunk").alias("of"), "at", "c", "by_pieces", "by_scores")
    base = lambda c: np.log10((c + 0.5) / (tokens_in + 0.5 * (kinds + 1)))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary_score", "mixed_score"]
    kind = documents.schema["doc_id"].dataType.simpleString()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """One chunk and the values of its words."""
        _, order = np.unique(right.column("at").to_numpy(), return_index=True)
        c, by_pieces, by_scores = (right.column(name).to_numpy()[order].astype(np.float64) for name in ("c", "by_pieces", "by_scores"))
        row = left.slice(0, 1)
        flat = lambda name: row.column(name).combine_chunks().flatten()
        length, tokens = flat("n").to_numpy(), _unpacked(row.column("tokens")[0].as_py())
        owner = np.repeat(np.arange(len(length)), length)
        total = lambda values: np.bincount(owner, values[tokens], len(length))
        known = total((c > 0).astype(float)).astype(np.int64) + (1 if ends else 0)
        end = math.log10(learned.end_p)
        sums = [total(base(c)) + base(ends), total(by_pieces) + end, total(by_scores) + end, total(learned.mixed(by_pieces, c)) + end]
        return pa.table([flat("doc_ids"), flat("held_out"), pa.array(length + 1), pa.array(known), pa.array(np.full(len(length), tokens_in, np.int64)), *map(pa.array, sums)], names)

    both = chunks.select("chunk", "doc_ids", "held_out", "n", "tokens").groupBy("chunk").cogroup(answers.groupBy("of"))
    return both.applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, vocabulary_score double, mixed_score double")

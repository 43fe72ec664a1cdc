"""Groups of spelling variants by k-d trees over letter counts (operator 11).

Words that differ by one inserted, deleted or replaced code point have letter counts of which at most one is one higher and at most one
is one lower, so their L1 distance is at most two. Words of each length stand in a k-d tree over letter counts; a word asks the
tree of its own length (replaced) and that of the next (inserted or deleted), and a branch is left where its box is further away than
one up and one down. What is left in the leaves is compared by shared letters, and the order of the letters is verified at last.

The upper levels of the trees are split on a bounded sample of words (about `sample` of them, by hash; it decides how even the leaves are and
nothing else); their leaves are dealt over the cluster in blocks of bounded bytes, whichever words they hold, and each block
builds the lower levels for itself. Words go to the blocks of the leaves that their box test reaches, in blocks as well.
Letters beyond the 63 most frequent of the sample share one count, which keeps distances or lowers them.

Nulls: a null text has no words, a null doc_id is written as nothing in what is hashed. Empty texts have no words. Repeated rows count
each. An empty table gives no rows. Other columns are not read. Very long words are words like others, in blocks of fewer.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm._store import hot_keys, met, scratch, stored

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Letter counts of a word, words of a leaf of the upper levels, points of a leaf of the lower, upper leaves in all.
COUNTS, LEAF, POINTS, LEAVES = 64, 8192, 64, 4096
#: Bytes of words in a block, and words that ask in a block.
BLOCK, ASKING = 1 << 20, 1 << 15


def occurrences(documents: DataFrame, least: int = 6, noise: int = 199, distinct: int = 200_000) -> DataFrame:
    """(word, n): words of at least `least` letters with the times that they occur, summed for each task's documents.

    A word is a maximal run of [A-Za-z\\u00C0-\\u00FF], A-Z in lower case; where `noise` divides h, the CRC32 of <doc_id>:<run>, its
    code point h % length is taken out. A task holds at most `distinct` words and those of one document before it sends sums."""
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sums() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                # the letters are one byte each in this encoding, and no other character becomes a letter
                data = text.as_py().encode("latin-1", "replace").translate(_LOWER)
                for word, n in Counter(runs.findall(data)).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > distinct:
                    yield sums()
                    total.clear()
        yield sums()

    return documents.select("doc_id", "text").mapInArrow(run, "word string, n long")


class Letters:
    """Which count each letter is part of: the most frequent have one of their own."""

    def __init__(self, words: list[str]) -> None:
        often = Counter(c for w in words for c in w)
        self.of = {c: k for k, (c, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))[: COUNTS - 1])}

    def codes(self, words: list[str]) -> np.ndarray:
        """The code points of words of one length, a row each."""
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """The letter counts of words of one length, a row each."""
        letters, at = np.unique(codes, return_inverse=True)
        place = np.array([self.of.get(chr(c), COUNTS - 1) for c in letters], np.int64)[at.reshape(-1)]
        cells = np.repeat(np.arange(len(codes)), codes.shape[1]) * COUNTS + place
        return np.bincount(cells, minlength=len(codes) * COUNTS).reshape(len(codes), COUNTS).astype(np.int32)


def even_split(points: np.ndarray) -> tuple[int, int] | None:
    """The count and the value up to which points go left, such that both sides are as even as they can be; None where all points are equal."""
    best, found = 0, None
    n = len(points)
    for d in np.flatnonzero(points.min(axis=0) < points.max(axis=0)):
        upto = np.cumsum(np.bincount(np.minimum(points[:, d], 255)))[:-1]
        least = np.minimum(upto, n - upto)
        t = int(least.argmax())
        if least[t] > best:
            best, found = int(least[t]), (int(d), t)
    return found


class Tree:
    """A k-d tree over letter counts: `splits` of inner nodes, `leaves` (the numbers of their points) of the others."""

    def __init__(self, points: np.ndarray, most: int, depth: int = 64) -> None:
        self.nodes: list[tuple] = []
        self.leaves: list[np.ndarray] = []
        self._grow(points, np.arange(len(points)), most, depth)

    def _grow(self, points: np.ndarray, own: np.ndarray, most: int, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        split = even_split(points[own]) if len(own) > most and depth else None
        if split is None:
            self.nodes[at] = ("leaf", len(self.leaves))
            self.leaves.append(own)
        else:
            left = points[own, split[0]] <= split[1]
            self.nodes[at] = ("split", *split, self._grow(points, own[left], most, depth - 1), self._grow(points, own[~left], most, depth - 1))
        return at

    def reached(self, asking: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, which of asking): where a point may be that has at most `up` more and `down` fewer letters."""
        n, size = len(asking), asking.shape[1]
        # a box is the least and the greatest value of each count that a branch holds; most counts have no bound
        stack = [(0, np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), {}, {})]
        while stack:
            at, own, more, fewer, low, high = stack.pop()
            node = self.nodes[at]
            if node[0] == "leaf":
                yield node[1], own
                continue
            _, d, t, left, right = node
            value = asking[own, d]
            was = np.maximum(value - high[d], 0) if d in high else 0
            now = np.maximum(value - t, 0)
            keep = fewer - was + now <= down
            if keep.any():
                stack.append((left, own[keep], more[keep], (fewer - was + now)[keep], low, {**high, d: t}))
            was = np.maximum(low[d] - value, 0) if d in low else 0
            now = np.maximum(t + 1 - value, 0)
            keep = more - was + now <= up
            if keep.any():
                stack.append((right, own[keep], (more - was + now)[keep], fewer[keep], {**low, d: t + 1}, high))
        assert size == COUNTS

    def placed(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        for leaf, own in self.reached(points, 0, 0):
            out[own] = leaf
        return out


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of x and y, code points of words of one length or of y one longer, differ by exactly one edit."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    before = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= x.shape[1]


def _unary(counts: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Counts as zeros and ones, so that products are shared letters; columns: as many for each letter."""
    letter = np.repeat(np.arange(COUNTS), columns)
    least = np.arange(len(letter)) - np.repeat(np.cumsum(columns) - columns, columns)
    return (counts[:, letter] > least).astype(np.float32)


def near_pairs(asking: list[str], words: list[str], letters: Letters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which of asking, which of words) of all pairs one edit apart; all asking have one length, all words that length or one more."""
    x, y = letters.codes(asking), letters.codes(words)
    cx, cy = letters.counts(x), letters.counts(y)
    longer = y.shape[1] - x.shape[1]
    shared = x.shape[1] - 1 + longer  # letters that words one edit apart have in common
    tree = Tree(cy, POINTS)
    for leaf, own in tree.reached(cx, 1, 1 - longer):
        at = tree.leaves[leaf]
        columns = cy[at].max(axis=0)
        theirs = _unary(cy[at], columns)
        step = max(1, (1 << 22) // max(1, len(at), theirs.shape[1]))
        for start in range(0, len(own), step):
            some = own[start : start + step]
            i, j = np.nonzero(_unary(cx[some], columns) @ theirs.T >= shared)
            i, j = some[i], at[j]
            good = one_edit(x[i], y[j])
            if good.any():
                yield i[good], j[good]


def _trees(words: DataFrame, sample: int) -> tuple[Letters, dict[int, Tree], dict[int, int]]:
    """Letters, the upper tree of each length, and how many words there are of each length."""
    sizes = {r[0]: r[1] for r in words.groupBy("length").count().collect()}  # one for each length
    every = max(1, sum(sizes.values()))
    some = sorted(r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(-(-every // sample))) == 0).select("word").collect())  # about `sample` at most
    letters = Letters(some)
    each = max(LEAF, -(-every // LEAVES))
    trees = {}
    for length in sizes:
        own = [w for w in some if len(w) == length]
        points = letters.counts(letters.codes(own)) if own else np.zeros((0, COUNTS), np.int32)
        leaves = max(1, -(-sizes[length] // each))
        trees[length] = Tree(points, max(1, -(-len(own) // leaves)))
        trees[length].leaves = [np.zeros(0, np.int64)] * len(trees[length].leaves)  # the points are not shipped
    return letters, trees, sizes


def _routed(words: DataFrame, letters: Letters, trees: dict[int, Tree], asks: bool) -> DataFrame:
    """(length, leaf, word, n): of each word the leaf that holds it, or those that may hold words near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("word").to_pylist()
            of = np.array([len(w) for w in every])
            for length in np.unique(of).tolist():
                own = np.flatnonzero(of == length)
                for start in range(0, len(own), step := max(1, BLOCK // length)):
                    some = own[start : start + step]
                    counts = letters.counts(letters.codes([every[i] for i in some]))
                    to = [(length, 1, 1), (length + 1, 1, 0)] if asks else [(length, 0, 0)]
                    for there, up, down in to:
                        for leaf, at in trees[there].reached(counts, up, down) if there in trees else ():
                            taken = batch.take(pa.array(some[at]))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), there, np.int32)), pa.array(np.full(len(at), leaf, np.int32)), *taken.columns], ["there", "leaf", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "there int, leaf int, word string, n long")


def _near(words: DataFrame, sample: int) -> DataFrame:
    """(word, n_near, best): of each word that has near words their number and the greatest, as struct (minus n, word)."""
    letters, trees, _ = _trees(words, sample)
    held, asking = stored(_routed(words, letters, trees, False), "spelling-held"), stored(_routed(words, letters, trees, True), "spelling-asking")
    count = lambda df, name: df.groupBy("there", "leaf").agg(F.count("*").alias(name))
    sizes = count(held, "h").join(count(asking, "a"), ["there", "leaf"])
    sizes = stored(sizes.select("there", "leaf", F.ceil(F.col("h") * F.greatest("there", F.lit(COUNTS)) / BLOCK).cast("int").alias("hb"), F.ceil(F.col("a") * F.greatest("there", F.lit(32)) / (ASKING * 32)).cast("int").alias("ab")), "spelling-sizes")
    deal = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = asking.join(sizes, ["there", "leaf"]).select("there", "leaf", deal("ab").alias("x"), each("hb").alias("y"), "word", "n")
    y = held.join(sizes, ["there", "leaf"]).select("there", "leaf", deal("hb").alias("y"), each("ab").alias("x"), "word", "n")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
        if left.num_rows and right.num_rows:
            words, of_words = right.column("other").to_pylist(), right.column("m").to_numpy()
            every, n_every = left.column("word").to_pylist(), left.column("n").to_numpy()
            of = np.array([len(w) for w in every])
            for length in np.unique(of).tolist():
                own = np.flatnonzero(of == length)
                asks, n_asks = [every[i] for i in own], n_every[own]
                pairs = list(near_pairs(asks, words, letters))
                if not pairs:
                    continue
                i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
                sides = [(asks, i, words, j, of_words)] + ([(words, j, asks, i, n_asks)] if length < len(words[0]) else [])
                for names, a, others, b, n in sides:
                    # of each word the near one of the greatest n, then the smallest: rank the others once
                    rank = np.empty(len(others), np.int64)
                    rank[sorted(range(len(others)), key=lambda k: (-n[k], others[k]))] = np.arange(len(others))  # noqa: B023
                    order = np.lexsort((rank[b], a))
                    who, first, many = np.unique(a[order], return_index=True, return_counts=True)
                    top = b[order][first]
                    found["word"] += [names[k] for k in who]
                    found["n_near"].append(many)
                    found["best_n"].append(-n[top])
                    found["best"] += [others[k] for k in top]
        flat = lambda c: pa.array(np.concatenate(found[c]) if found[c] else [], pa.int64())
        return pa.table([pa.array(found["word"], pa.string()), flat("n_near"), flat("best_n"), pa.array(found["best"], pa.string())], list(found))

    key = ["there", "leaf", "x", "y"]
    found = x.groupBy(*key).cogroup(y.toDF("there", "leaf", "y", "x", "other", "m").groupBy(*key)).applyInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("best_n", "best")).alias("best"))


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the end of the way from form to form, which doubles its steps each round."""
    jumps = stored(formed.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hot = hot_keys(jumps, "root")
        ahead = stored(met(jumps, ahead, "root", hot, "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots", keep=True)
        if ahead.where("moved").isEmpty():
            return ahead.select("word", "root")
        jumps = ahead.select("word", "root")


def variants(documents: DataFrame, least: int = 6, often: int = 5, times: int = 5, sample: int = 1 << 16) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least `least` letters that occurs `often` times.

    A word's form is its near word of the greatest n (then the smallest), if that n is `times` its own or more; its root is where forms lead."""
    with scratch(documents.sparkSession):
        counted = occurrences(documents, least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
        words = stored(counted.withColumn("length", F.length("word")), "spelling-words", keep=True)
        near = _near(words, sample)
        enough = -F.col("best.best_n") >= times * F.col("n")
        formed = words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.best")).alias("form"), F.when(enough, -F.col("best.best_n")).alias("form_n")
        )
        formed = stored(formed, "spelling-forms", keep=True)
        roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

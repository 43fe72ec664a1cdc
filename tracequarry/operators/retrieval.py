"""Retrieval for a batch of queries: BM25, exact vector neighbours, fusion, cut-offs and evaluation.

Frames: corpus(doc_id, tokens), queries(query_id, tokens), vectors(id, vector), ranked(query_id, doc_id, rank, ...).
Every ranking breaks ties by doc_id. Common tokens are handled by the join on tokens, whose skew AQE splits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracequarry.functions import text as tx
from tracequarry.store import scratch, stored


def top(scores: DataFrame, k: int, by: str = "score", within: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank, by score from high to low and doc_id."""
    order = Window.partitionBy(within).orderBy(F.desc(by), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(corpus: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl)"""
    sized = corpus.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return sized.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(corpus: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, repeat_terms: bool = True, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score > 0) of Okapi BM25; with k, at least the k best documents of each query, ties among them.

    idf = ln((N - df + 0.5) / (df + 0.5)); negative ones become a quarter of the mean idf over all terms. repeat_terms: a
    token counts as often as the query has it. Only terms of queries are scored, but df, N and the mean cover the corpus.

    A document's distinct terms are counted in a map-side combine for df, which is stored once, sizes and the mean are three numbers; then a batch of queries of checked
    size meets blocks of documents as matrices, and a larger one by joins on terms.
    """
    weighed, asked, n_cells = _weighed(corpus, queries)
    if n_cells <= CELLS:
        return _bm25_blocks(corpus, Lexical(weighed, asked, k1, b, repeat_terms), asked, k)
    # tokens meet the queries' terms before they are counted: the terms are broadcast if Catalyst's limit allows, else exchanged
    spots = corpus.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(weighed, "term")
    hits = spots.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("idf").alias("idf"), F.first("avgdl").alias("avgdl"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = hits.select("term", "doc_id", part.alias("part")).join(asked, "term")
    weight = F.col("qtf") if repeat_terms else F.lit(1)
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("part") * weight).alias("score")).where("score > 0")


#: Terms times queries up to which a batch of queries is one matrix in every task (8 bytes a cell); a larger batch is joined.
CELLS = 1 << 22


def _weighed(corpus: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The queries' terms that the corpus has (term, idf, avgdl), those asked (query_id, term, qtf), and the number of terms times queries. A corpus without tokens has t, lower texts, whose runs are counted."""
    with scratch(corpus.sparkSession):
        if "tokens" in corpus.columns:
            df = stored(corpus.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "bm25-df", keep=True)
            n_docs, avgdl = corpus.agg(F.count("*"), F.avg(F.size("tokens"))).first()
        else:
            counted = stored(_run_counts(corpus), "bm25-df", keep=True)
            df = counted.where("term is not null").select("term", "df")
            n_docs, n_tokens = counted.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
            avgdl = n_tokens / n_docs if n_docs else None
    raw = df.withColumn("raw", F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw")).first()[0]
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = asked.select("term").distinct()
    idf = F.when(F.col("raw") < 0, 0.25 * F.lit(mean)).otherwise(F.col("raw"))
    weighed = raw.join(terms, "term").select("term", idf.alias("idf"), F.lit(avgdl).cast("double").alias("avgdl"))
    return weighed, asked, terms.count() * max(1, queries.count())


def _run_counts(corpus: DataFrame, most: int = 1 << 18) -> DataFrame:
    """(term, df, n): in how many lower texts t each run stands; the rows without a term add up to the number of texts (df) and of their runs (n). Texts are read once, where they lie; a task holds `most` terms."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.nulls(len(seen), pa.int64())], ["term", "df", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n_docs, n_runs = Counter(), 0, 0
        for batch in batches:
            for t in batch.column("t").to_pylist():
                found = _RUN.findall(t) if t else []
                n_docs, n_runs = n_docs + 1, n_runs + len(found)
                seen.update(set(found))
                if len(seen) > most:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([n_docs]), pa.array([n_runs])], ["term", "df", "n"])

    return corpus.select("t").mapInArrow(run, "term string, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


class Lexical:
    """BM25 of a batch of questions whose size the caller has checked: the product of a block of documents by terms and the matrix of terms by questions.

    weighed and asked as of _weighed; questions: their ids in the order of the columns, by default those that have terms."""

    def __init__(self, weighed: DataFrame, asked: DataFrame, k1: float = 1.5, b: float = 0.75, repeat_terms: bool = True, questions: list | None = None) -> None:
        found = weighed.collect()  # at most CELLS terms
        number = {r["term"]: i for i, r in enumerate(found)}
        rows = asked.where(F.col("term").isNotNull()).collect()  # at most CELLS pairs
        self.questions = list(dict.fromkeys(r["query_id"] for r in rows)) if questions is None else questions
        of = {q: i for i, q in enumerate(self.questions)}
        self.matrix = np.zeros((len(number), len(of)))
        for r in rows:
            if r["term"] in number:
                self.matrix[number[r["term"]], of[r["query_id"]]] = found[number[r["term"]]]["idf"] * (r["qtf"] if repeat_terms else 1)
        self.avgdl = found[0]["avgdl"] if found else 1.0
        self.k1, self.b, self.vocabulary = k1, b, pa.array(list(number), pa.string())
        self.number: dict[str, int] | None = None
        self.step = max(1, min(512, CELLS // max(1, len(number))))  # so that documents times terms are no more cells than the matrix has

    def scores(self, tokens: pa.ListArray) -> np.ndarray:
        """Scores of documents, at most `step`, by questions."""
        dl = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
        at = pc.fill_null(pc.index_in(pc.list_flatten(tokens), self.vocabulary), -1).to_numpy(zero_copy_only=False)
        n, n_terms = len(tokens), len(self.vocabulary)
        tf = np.bincount(np.repeat(np.arange(n), dl)[at >= 0] * n_terms + at[at >= 0], minlength=n * n_terms).reshape(n, n_terms).astype(np.float64)
        share = np.divide(tf * (self.k1 + 1), tf + self.k1 * (1 - self.b + self.b * dl[:, None] / self.avgdl), out=np.zeros_like(tf), where=tf > 0)
        return share @ self.matrix

    def scores_of(self, runs: "Runs") -> np.ndarray:
        """The same of texts whose tokens are their runs."""
        if self.number is None:  # made in the task
            self.number = {t: i for i, t in enumerate(self.vocabulary.to_pylist())}
        n, n_terms = runs.n, len(self.vocabulary)
        dl = np.bincount(runs.owner, runs.tf, n)
        at = np.fromiter((self.number.get(r, -1) for r in runs.names), np.int64, len(runs.names))[runs.run]
        known = at >= 0
        tf = np.bincount(runs.owner[known] * n_terms + at[known], runs.tf[known], n * n_terms).reshape(n, n_terms)
        share = np.divide(tf * (self.k1 + 1), tf + self.k1 * (1 - self.b + self.b * dl[:, None] / self.avgdl), out=np.zeros_like(tf), where=tf > 0)
        return share @ self.matrix


class Runs:
    """The runs of a block of lower texts: names, distinct ones, and for each text (owner) and run of it (run, its place in names) how often it stands there (tf)."""

    def __init__(self, texts: list[str | None]) -> None:
        local: dict[str, int] = {}
        counts = [Counter(_RUN.findall(t)) if t else {} for t in texts]
        sizes = [len(c) for c in counts]
        total, self.n = sum(sizes), len(texts)
        self.run = np.fromiter((local.setdefault(r, len(local)) for c in counts for r in c), np.int64, total)
        self.tf = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, total)
        self.owner = np.repeat(np.arange(self.n), sizes)
        self.names = list(local)


def _bm25_blocks(corpus: DataFrame, lexical: Lexical, asked: DataFrame, k: int | None) -> DataFrame:
    """Scores in blocks. Pairs of a query and a document leave a task once, with their score; nothing is joined or exchanged."""
    query_kind, doc_kind = asked.schema["query_id"].dataType, corpus.schema["doc_id"].dataType
    ids = pa.array(lexical.questions, to_arrow_type(query_kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, lexical.step) for i in range(0, batch.num_rows, lexical.step)):
                scores = lexical.scores(part.column("tokens"))
                keep = scores > 0
                if k is not None and k < part.num_rows:  # from a little below the kth best score on, which may be more than k rows
                    keep &= scores >= np.partition(scores, part.num_rows - k, axis=0)[part.num_rows - k] - 1e-6
                doc, q = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), part.column("doc_id").take(pa.array(doc)), pa.array(scores[doc, q])], ["query_id", "doc_id", "score"])

    return corpus.select("doc_id", "tokens").mapInArrow(run, f"query_id {query_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score double")


#: Vectors and queries that a task multiplies at a time.
BLOCK = (4096, 1024)


def similarities(vectors: DataFrame, queries: DataFrame, k: int | None = None, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every query and vector by cosine (9 digits), itself not counted; with k, at least the k best of each query.

    vectors(doc_id, vector), queries(query_id, vector), a stated set of queries. Vectors and queries are dealt into so many
    blocks each, by default so many that a block has about BLOCK rows; a task multiplies one block of either.
    """
    if blocks is None:
        blocks = tuple(max(1, -(-df.count() // size)) for df, size in zip((vectors, queries), BLOCK, strict=True))
    by = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.select("doc_id", "vector", by("doc_id", blocks[0]).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))).alias("qb"))
    right = queries.select("query_id", F.col("vector").alias("asked"), by("query_id", blocks[1]).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1))).alias("vb"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        m = pc.list_flatten(column).to_numpy().astype(np.float64).reshape(len(column), -1)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length > 0, length, 1)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "doc_id", "score"])
        ids, asked = a.column("doc_id").to_numpy(), b.column("query_id").to_numpy()
        score = np.round(matrix(b.column("asked")) @ matrix(a.column("vector")).T, 9)
        score[asked[:, None] == ids[None, :]] = -2
        keep = score > -2
        if k is not None and k < len(ids):  # from the kth best score on, which may be more than k rows
            keep &= score >= np.partition(score, len(ids) - k, axis=1)[:, [len(ids) - k]]
        q, v = np.nonzero(keep)
        if k is not None:  # of equal scores the least ids
            order = np.lexsort((ids[v], -score[q, v], q))
            q, v = q[order], v[order]
            first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
            q, v = q[first], v[first]
        return pa.table([pa.array(asked[q]), pa.array(ids[v]), pa.array(score[q, v])], ["query_id", "doc_id", "score"])

    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(best, "query_id long, doc_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k most similar vectors of each query by cosine (9 digits), itself not counted; frames as in similarities, of which a task keeps k rows per query."""
    return top(similarities(vectors, queries, k, blocks), k)


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, k: int = 60, boosts: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score) from two rankings; a list that lacks a document adds nothing."""
    a = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    b = lexical.select("query_id", "doc_id", F.col("rank").alias("lexical_rank"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    share = lambda rank: F.coalesce(1 / (k + F.col(rank)), F.lit(0.0))
    return both.withColumn("score", share("dense_rank") + share("lexical_rank") + (boosts if boosts is not None else F.lit(0.0)))


def boost(query: Column, content: Column, tokens: Column, identifiers: Column) -> Column:
    """At most 0.09: 0.03 for the phrase, 0.003 per token of over two characters, 0.012 per identifier found."""
    lower = F.lower(content)
    count = lambda items: F.size(F.filter(items, lambda t: F.contains(lower, F.lower(t))))
    phrase = F.when(F.contains(lower, F.lower(query)), 0.03).otherwise(0.0)
    return F.least(F.lit(0.09), phrase + 0.003 * count(F.filter(tokens, lambda t: F.length(t) > 2)) + 0.012 * count(identifiers))


def exact_score(query: Column, content: Column, tokens: Column, identifiers: Column) -> Column:
    """80 for the phrase, 12 per occurrence of a token up to 48 for each, 90 per identifier."""
    lower = F.lower(content)
    times = lambda t: (F.length(lower) - F.length(F.replace(lower, t, F.lit("")))) / F.length(t)
    by_token = F.aggregate(tokens, F.lit(0.0), lambda total, t: total + F.least(12 * times(t), F.lit(48.0)))
    found = F.size(F.filter(identifiers, lambda i: F.contains(lower, F.lower(i))))
    return F.when(F.contains(lower, F.lower(query)), 80).otherwise(0) + by_token + 90 * found


def exact_scores(documents: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) above 0; with k, at least the k best documents of each query, by score and doc_id: 80 for the whole query text, 12 for each occurrence of each of its distinct tokens up to 48 a token, 90
    for each identifier of the document that the query names.

    documents(doc_id, text, optionally identifiers array), queries(query_id, text, optionally tokens array of letters, digits and _ . / : -; else all such runs
    of the text), one row for each id; case aside. Whole texts, and tokens of any length. A token occurs inside maximal runs of its characters only, so tokens meet
    the distinct runs of all documents by equality with the runs' substrings of the tokens' lengths, and runs meet documents by equality. The whole
    text is looked up where all its tokens occur; a query without tokens is itself looked up inside runs of other characters. Identifiers (letters and
    digits compared) meet the queries' substrings of their lengths. Null or empty texts and identifiers meet nothing.

    A batch of queries of checked size meets blocks of documents as matrices, where nothing is joined or exchanged; a larger one by the joins told above."""
    token_runs, other_runs = F.lit(_RUN.pattern), F.lit("[^a-z0-9_./:-]+")
    runs = lambda c, kind: F.regexp_extract_all(F.col(c), kind, F.lit(0))
    asked, fits = exact_questions(queries)
    if fits:
        return _exact_blocks(documents, asked.withColumn("c", tx.compact(F.col("q"))), k)
    both = F.transform(F.array_union("ts", "ps"), lambda x: F.struct(x.alias("needle"), F.array_contains("ts", x).alias("scored"), F.array_contains("ps", x).alias("needed")))
    needles = asked.select("query_id", F.size("ps").alias("n"), F.explode(both).alias("b")).select("query_id", "n", "b.*").where("needle <> ''")
    texts = documents.select("doc_id", F.lower("text").alias("t")).where("t <> ''")
    lengths = [r[0] for r in needles.select(F.length("needle")).distinct().collect()]  # no more than the longest has characters
    odd = not needles.where(~F.col("needle").rlike("[a-z0-9_./:-]")).isEmpty()
    pieces = F.concat(runs("t", token_runs), runs("t", other_runs)) if odd else runs("t", token_runs)
    words = texts.select("doc_id", F.explode(pieces).alias("run")).groupBy("doc_id", "run").agg(F.count("*").alias("tf"))
    held = _parts(words.select("run").distinct(), "run", lengths).join(needles.select(F.col("needle").alias("part")).distinct(), "part")
    times = (F.length("run") - F.length(F.replace(F.col("run"), F.col("part"), F.lit("")))) / F.length("part")
    found = words.join(held.select("run", F.col("part").alias("needle"), times.alias("times")), "run").groupBy("doc_id", "needle").agg(F.sum(F.col("tf") * F.col("times")).alias("times"))
    points = F.when(F.col("scored"), F.least(12 * F.col("times"), F.lit(48.0))).otherwise(0.0)
    by_token = found.join(needles, "needle").groupBy("query_id", "doc_id").agg(F.sum(points).alias("score"), (F.count_if("needed") == F.max("n")).alias("_all"))
    maybe = by_token.where("_all").select("query_id", "doc_id").join(asked.select("query_id", "q"), "query_id").join(texts, "doc_id")
    scores = by_token.select("query_id", "doc_id", "score").unionByName(maybe.where(F.contains("t", F.col("q"))).select("query_id", "doc_id", F.lit(80.0).alias("score")))
    if "identifiers" in documents.columns:
        names = documents.select("doc_id", F.explode("identifiers").alias("i")).select("doc_id", tx.compact(F.col("i")).alias("part")).where("part <> ''")
        each = names.groupBy("doc_id", "part").agg((90.0 * F.count("*")).alias("score"))
        sizes = [r[0] for r in names.select(F.length("part")).distinct().collect()]
        said = _parts(asked.select("query_id", tx.compact(F.col("q")).alias("c")), "c", sizes).select("query_id", "part")
        scores = scores.unionByName(said.join(each, "part").select("query_id", "doc_id", "score"))
    return scores.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")).where("score > 0")


def exact_questions(queries: DataFrame) -> tuple[DataFrame, bool]:
    """(query_id, q, ts, ps) of queries as of exact_scores: lower text, its tokens, and the runs it needs; and whether they are few enough to be matrices in every task."""
    runs = lambda c: F.regexp_extract_all(F.col(c), F.lit(_RUN.pattern), F.lit(0))
    asked = queries.select("query_id", F.lower("text").alias("q"), *(["tokens"] if "tokens" in queries.columns else [])).where("q <> ''")
    tokens = F.array_distinct(F.transform("tokens", F.lower)) if "tokens" in queries.columns else F.array_distinct(runs("q"))
    parts = F.array_distinct(runs("q"))
    asked = asked.select("query_id", "q", F.coalesce(tokens, F.array().cast("array<string>")).alias("ts"), F.when(F.size(parts) > 0, parts).otherwise(F.array("q")).alias("ps"))
    told = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("q")), F.lit(0)), F.coalesce(F.sum(F.size("ts") + F.size("ps")), F.lit(0))).first()
    few = told[0] * told[2] <= 4 * CELLS and told[1] <= 8 * CELLS
    return asked, few and asked.select(F.explode(F.array_union("ts", "ps"))).distinct().count() * max(1, told[0]) <= CELLS


class Exact:
    """Exact scores of a batch of questions, as matrices: rows of asked are (query_id, q, ts, ps, c), see exact_scores."""

    #: Runs and identifiers that a task remembers.
    MOST = 200_000

    def __init__(self, asked: list) -> None:
        self.questions = [r["q"] for r in asked]
        self.compacts = [r["c"] for r in asked]
        self.number: dict[str, int] = {}
        self.scored: list[tuple[int, int]] = []  # needle, question
        self.needed: list[tuple[int, int]] = []
        self.odd: list[tuple[str, int]] = []  # tokens of other characters
        for i, r in enumerate(asked):
            for t in r["ts"]:
                if t and _RUN.fullmatch(t):
                    self.scored.append((self.number.setdefault(t, len(self.number)), i))
                elif t:
                    self.odd.append((t, i))
            self.needed += [(self.number.setdefault(t, len(self.number)), i) for t in r["ps"] if _RUN.fullmatch(t)]
        self.longest = max(map(len, self.number), default=0)
        self.ready = False

    def _begin(self) -> None:
        """What is large or remembered is made in the task."""
        self.ready, shape = True, (len(self.number), len(self.questions))
        self.points, self.parts = np.zeros(shape), np.zeros(shape, np.float32)
        for a, pairs in ((self.points, self.scored), (self.parts, self.needed)):
            if pairs:
                a[tuple(np.array(pairs).T)] = 1
        self.n_parts = self.parts.sum(axis=0)
        self.runs: dict[str, tuple[list[int], list[int]]] = {}
        self.named: dict[str, list[int]] = {}
        self.trie: dict = {}  # letters to nodes; "" to the needle that ends there
        for needle in self.number:
            node = self.trie
            for c in needle:
                node = node.setdefault(c, {})
            node[""] = needle

    def _inside(self, run: str) -> tuple[list[int], list[int]]:
        """Needles that a run holds, and how often, without overlap."""
        if (found := self.runs.get(run)) is None:
            if len(self.runs) >= self.MOST:
                self.runs.clear()
            held = set()
            for i in range(len(run)):
                node = self.trie
                for c in run[i : i + self.longest]:
                    node = node.get(c)
                    if node is None:
                        break
                    if "" in node:
                        held.add(node[""])
            found = self.runs[run] = ([self.number[h] for h in held], [run.count(h) for h in held])
        return found

    def scores(self, texts: list[str | None], identifiers: list[list[str | None] | None] | None = None, runs: Runs | None = None) -> np.ndarray:
        """Scores of texts (lower case) by questions; identifiers are compact, runs those of the texts."""
        if not self.ready:
            self._begin()
        runs = Runs(texts) if runs is None else runs
        n, (n_needles, n_questions) = len(texts), self.points.shape
        held = [self._inside(r) for r in runs.names]
        sizes = np.array([len(h) for h, _ in held], np.int64)
        needle, often = (np.fromiter(chain.from_iterable(h[c] for h in held), np.int64, int(sizes.sum())) for c in (0, 1))
        first = np.concatenate(([0], np.cumsum(sizes)))
        many = sizes[runs.run]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[runs.run], many)
        times = np.bincount(np.repeat(runs.owner * n_needles, many) + needle[at], np.repeat(runs.tf, many) * often[at], n * n_needles).reshape(n, n_needles)
        out = np.minimum(12 * times, 48) @ self.points
        for token, q in self.odd:
            out[:, q] += [min(12 * t.count(token), 48) if t else 0 for t in texts]
        maybe = ((times > 0).astype(np.float32) @ self.parts) == self.n_parts
        for d, q in zip(*np.nonzero(maybe), strict=True):
            if texts[d] and self.questions[q] in texts[d]:
                out[d, q] += 80
        for d, names in enumerate(identifiers or []):
            for name in names or []:
                if name:
                    if (of := self.named.get(name)) is None:
                        if len(self.named) >= self.MOST:
                            self.named.clear()
                        of = self.named[name] = [q for q, c in enumerate(self.compacts) if name in c]
                    out[d, of] += 90
        return out


_RUN = re.compile("[a-z0-9_./:-]+")


def blocks(batch: pa.RecordBatch, text: str, rows: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in blocks of so many rows, and of about that many bytes of text or one row, at most."""
    begin = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if i > begin and (i - begin >= rows or held + n > size):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def _exact_blocks(documents: DataFrame, asked: DataFrame, k: int | None) -> DataFrame:
    """exact_scores of a batch whose size the caller has checked. Pairs of a query and a document leave a task once, with their score; with k no more than the k best of a block."""
    query_kind, doc_kind = asked.schema["query_id"].dataType, documents.schema["doc_id"].dataType
    rows = asked.collect()
    exact, ids = Exact(rows), pa.array([r["query_id"] for r in rows], to_arrow_type(query_kind))
    names = "identifiers" in documents.columns
    step = max(1, min(512, CELLS // max(1, len(exact.number))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "t", step):
                docs = part.column("doc_id")
                order = pc.sort_indices(docs).to_numpy()
                scores = exact.scores(part.column("t").to_pylist(), part.column("identifiers").to_pylist() if names else None)[order]
                keep = scores > 0
                if k is not None and k < part.num_rows:
                    best = np.zeros_like(keep)
                    np.put_along_axis(best, np.argsort(-scores, axis=0, kind="stable")[:k], True, axis=0)
                    keep &= best
                doc, q = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), docs.take(pa.array(order[doc])), pa.array(scores[doc, q], pa.float64())], ["query_id", "doc_id", "score"])

    told = documents.select("doc_id", F.lower("text").alias("t"), *([F.transform("identifiers", lambda i: tx.compact(i)).alias("identifiers")] if names else []))
    return told.mapInArrow(run, f"query_id {query_kind.simpleString()}, doc_id {doc_kind.simpleString()}, score double")


def _parts(df: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """df with `part`, a row for each distinct substring of the column that has one of the lengths."""
    sizes = F.array(*[F.lit(x) for x in sorted(lengths)]).cast("array<int>")
    fitting = F.filter(sizes, lambda x: x <= F.length(column))
    every = F.flatten(F.transform(fitting, lambda x: F.transform(F.sequence(F.lit(1), F.length(column) - x + 1), lambda i: F.substring(F.col(column), i, x))))
    return df.withColumn("part", F.explode(F.array_distinct(every)))


def linear_fusion(scores: DataFrame, weights: dict[str, float], floor: float = 0.30, share: float = 0.58, k: int = 10, digits: int = 12) -> DataFrame:
    """Weighted sum of score columns, each divided by its greatest value within the query; kept from max(floor, share * best) on."""
    of_query = Window.partitionBy("query_id")
    parts = [w * F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), F.nullif(F.max(F.coalesce(F.col(c), F.lit(0.0))).over(of_query), F.lit(0.0))), F.lit(0.0)) for c, w in weights.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    scored = scores.withColumn("score", F.round(total, digits))
    kept = scored.withColumn("best", F.max("score").over(of_query)).where(F.col("score") >= F.greatest(F.lit(floor), share * F.col("best")))
    return top(kept.drop("best"), k)


def evaluate(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row per judged query: precision and recall at k, reciprocal rank, ndcg. ranked(query_id, doc_id, rank), relevant(query_id, doc_id)."""
    wanted = relevant.select("query_id", "doc_id").distinct()
    hits = ranked.join(wanted, ["query_id", "doc_id"], "left_semi")
    return evaluate_hits(hits, wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant")), k)


def evaluate_hits(hits: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """As evaluate, from the relevant results alone, hits(query_id, rank), and totals(query_id, n_relevant)."""
    gained = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda total, r: total + 1 / F.log2(r + 1))
    found = F.coalesce("found", F.lit(0))
    return totals.where("n_relevant > 0").join(gained, "query_id", "left").select(
        "query_id", (found / k).alias("precision"), (found / F.col("n_relevant")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )


def isolation_violations(ranked: DataFrame) -> DataFrame:
    """Results outside their query's scope, and documents listed twice: (query_id, doc_id, violation). Expected empty."""
    outside = ranked.where(~F.col("scope").eqNullSafe(F.col("query_scope"))).select("query_id", "doc_id", F.lit("OUT_OF_SCOPE").alias("violation"))
    twice = ranked.groupBy("query_id", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", "doc_id", F.lit("DUPLICATE").alias("violation"))
    return outside.unionByName(twice)


#: First words of a vocabulary that are sent to every task.
HEADS = 10_000


def mention_join(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, term): vocabulary terms (one or more words) that a text holds as whole words, through an inverted index.

    Texts meet terms on the terms' first words only; the rest is checked on the words that follow.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    terms = vocabulary.select("term", words(F.col("term")).alias("tw")).where("size(tw) > 0").select("term", F.get("tw", F.lit(0)).alias("first"), padded(F.col("tw")).alias("told"))
    heads = terms.select("first").distinct()
    each = documents.select("doc_id", words(F.col("text")).alias("w"))
    if heads.limit(HEADS + 1).count() <= HEADS:
        # few first words: a text keeps those that it holds before anything is exploded
        few = F.broadcast(heads.agg(F.collect_set("first").alias("heads")))  # one row of at most HEADS words
        spots = each.crossJoin(few).select("doc_id", padded(F.col("w")).alias("padded"), F.explode(F.array_intersect("w", "heads")).alias("first"))
        found = spots.join(terms, "first")
    else:
        # many: ids meet first words, and texts come back only to the terms that are left
        spots = each.select("doc_id", F.explode(F.array_distinct("w")).alias("first")).join(heads, "first", "left_semi")
        found = spots.join(terms, "first").join(each.select("doc_id", padded(F.col("w")).alias("padded")), "doc_id")
    return found.where(F.contains("padded", F.col("told"))).select("doc_id", "term").distinct()

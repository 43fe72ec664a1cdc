"""Exact search for the greatest inner products in buckets of vectors of like length (operator 12).

Vectors are sorted by length and cut into blocks, the buckets. A query's threshold is its k-th best product so far; divided by the
query's length and the bucket's greatest length it is the least cosine that still matters there. A bucket that no cosine can reach
is skipped. Elsewhere each query takes what leaves it fewer rows: pruning by length (the longest rows of the bucket, up to the one
whose length alone falls short) or by a coordinate (rows whose unit coordinate lies in the interval that the cosine allows on one of the
query's largest coordinates). Products of the rows left are computed exactly, as integers.

All queries meet the longest buckets first, which gives each a threshold; a block of queries, whose needs are alike, then meets only
those further buckets that are long enough for one of its queries, a run of buckets at a time, with a threshold that rises on the way.
So a task holds one block of queries and one run of buckets, however large the table is.

Nulls: vectors that are null, empty or hold a null or a component that is not finite take no part, neither as queries nor as rows; a null id
is no query and ranks last in ties. Vectors of different lengths are filled up with zeros. Repeated rows are rows: a query leaves out
itself only, not its copies, and gives results for each of its rows. An empty table gives no rows. Products beyond a long wrap around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.llm._store import stored

#: Components in a block of vectors, blocks in a run, rows that length pruning may leave for each row that coordinate pruning leaves.
BLOCK, RUN, WORTH = 1 << 17, 8, 16
#: Coordinates of a query that are tried: those of the greatest size.
FOCUS = 4
_LAST = np.iinfo(np.int64).max
#: The least need: of any length.
_NONE = -1e300
_BLOCKS = "block long, n int, dim int, longest double, ids binary, nulls binary, vectors binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null for a vector that takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & (F.size(doubles) > 0), F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def blocks(vectors: DataFrame) -> DataFrame:
    """vectors(id, vector: array<long>) as rows of blocks, each of vectors of like length, longest first."""
    squared = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    sized = vectors.select("id", "vector", F.sqrt(squared).alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            lists = batch.column("vector")
            sizes = lists.value_lengths().to_numpy()
            at = 0
            while at < batch.num_rows:
                dim = int(sizes[at])
                end = at + max(1, BLOCK // max(1, dim))
                end = at + int(np.argmax(np.append(sizes[at:end] != dim, True)))  # a block has vectors of one dimension
                part = batch.slice(at, end - at)
                lengths = part.column("length").to_numpy()
                ids, nulls = part.column("id").fill_null(0).to_numpy(), part.column("id").is_null().to_numpy(zero_copy_only=False)
                values = part.column("vector").flatten().to_numpy().astype("<i8")
                one = lambda x: pa.array([x])
                yield pa.RecordBatch.from_arrays(
                    [one(number), pa.array([end - at], pa.int32()), pa.array([dim], pa.int32()), one(float(lengths.max())), one(ids.astype("<i8").tobytes()), one(nulls.tobytes()), one(values.tobytes())],
                    [f.split()[0] for f in _BLOCKS.split(", ")],
                )
                number += 1
                at = end

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sized.repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    return dealt.mapInArrow(run, _BLOCKS)


def _matrix(blob: bytes, n: int, dim: int, width: int) -> np.ndarray:
    out = np.zeros((n, width), np.int64)
    out[:, :dim] = np.frombuffer(blob, np.int64).reshape(n, dim)
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of x with rows of y: in doubles where every partial sum is a whole number below 2^53."""
    bound = np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((y.astype(float) ** 2).sum(1).max(initial=0))
    if bound < 1 << 52:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return x @ y.T


class Best:
    """The k greatest products of each query so far, ties to the smaller id, and their k-th as threshold."""

    def __init__(self, n: int, k: int, threshold: np.ndarray) -> None:
        self.n, self.k, self.threshold = n, k, threshold
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        query, score, id_ = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, query))
        query, score, id_ = query[order], score[order], id_[order]
        first = np.searchsorted(query, np.arange(self.n))
        rank = np.arange(len(query)) - first[query]
        keep = rank < self.k
        kth = np.flatnonzero(rank == self.k - 1)
        self.threshold[query[kth]] = np.maximum(self.threshold[query[kth]], score[kth])
        self.query, self.score, self.id = query[keep], score[keep], id_[keep]


class Bucket:
    """A block of rows: unit vectors, lengths in falling order, and each coordinate sorted when it is first asked for."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        lengths = np.sqrt((rows.astype(float) ** 2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        self.rows, self.ids, self.places, self.lengths = rows[order], ids[order], places[order], lengths[order]
        self.unit = self.rows / np.maximum(self.lengths, 1e-300)[:, None]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._sorted[f] = order, self.unit[order, f]
        return self._sorted[f]

    def ranges(self, unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the coordinate whose interval leaves the fewest rows, and that range in the sorted coordinate."""
        n = len(unit)
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, : min(FOCUS, unit.shape[1])]
        best, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.rows))
        for f in np.unique(focus):
            asks = np.flatnonzero((focus == f).any(axis=1))
            middle, reach = unit[asks, f] * cosine[asks], np.sqrt(np.maximum(0, (1 - cosine[asks] ** 2) * (1 - unit[asks, f] ** 2)))
            values, own = self.coordinate(int(f))[1], unit[asks, f]
            # a coordinate beyond the cosine can be met by a vector that lies along it
            least, most = np.where(own < -cosine[asks], -1.0, middle - reach), np.where(own > cosine[asks], 1.0, middle + reach)
            a, b = np.searchsorted(values, least - 1e-9), np.searchsorted(values, most + 1e-9, "right")
            better = b - a < high[asks] - low[asks]
            at = asks[better]
            best[at], low[at], high[at] = f, a[better], b[better]
        return best, low, high


def search(queries: np.ndarray, places: np.ndarray, bucket: Bucket, best: Best) -> dict[str, int]:
    """Adds a bucket's rows to the best of the queries. Returns how many (query, row) were left by which pruning."""
    seen = {"length": 0, "coordinate": 0}
    lengths = np.sqrt((queries.astype(float) ** 2).sum(1))
    has = best.threshold > -_LAST
    limit = np.where(has, best.threshold.astype(float), -np.inf)
    limit = limit - 1e-9 * np.abs(limit)  # roundings never prune
    needed = np.where(lengths > 0, limit / np.maximum(lengths, 1e-300), np.where(limit > 0, np.inf, -np.inf))  # of a row's length
    upto = np.searchsorted(-bucket.lengths, -needed, "right")  # rows that are long enough
    asks = np.flatnonzero(upto > 0)
    if not len(asks):
        return seen
    cosine = needed[asks] / bucket.lengths[0] if bucket.lengths[0] > 0 else np.full(len(asks), -1.0)
    by_coordinate = np.zeros(len(asks), bool)
    can = (cosine > 0) & (cosine <= 1)
    if can.any():
        unit = queries[asks[can]] / np.maximum(lengths[asks[can]], 1e-300)[:, None]
        f, low, high = bucket.ranges(unit, cosine[can])
        few = WORTH * (high - low) < upto[asks[can]]
        by_coordinate[np.flatnonzero(can)[few]] = True
        for q, coordinate, a, b in zip(asks[can][few], f[few], low[few], high[few], strict=True):
            rows = bucket.coordinate(int(coordinate))[0][a:b]
            rows = rows[(rows < upto[q]) & (bucket.places[rows] != places[q])]
            seen["coordinate"] += len(rows)
            score = products(queries[q : q + 1], bucket.rows[rows])[0]
            rows, score = rows[score >= best.threshold[q]], score[score >= best.threshold[q]]
            best.add(np.full(len(rows), q), score, bucket.ids[rows])
    by_length = asks[~by_coordinate]
    for start in range(0, len(by_length), 256):
        some = by_length[start : start + 256]
        rows = int(upto[some].max())
        seen["length"] += rows * len(some)
        score = products(queries[some], bucket.rows[:rows])
        other = places[some][:, None] != bucket.places[None, :rows]
        score = np.where(other, score, -_LAST)
        kth = np.partition(score, -best.k, axis=1)[:, -best.k] if rows >= best.k else np.full(len(some), -_LAST)
        q, row = np.nonzero(other & (score >= np.maximum(kth, best.threshold[some])[:, None]))
        best.add(some[q], score[q, row], bucket.ids[row])
    return seen


def _searched(asked: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """The best rows of each query in each group (q_block, run): of one block of queries and the buckets of one run, longest first."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {name: [] for name in ("place", "query_id", "score", "vec_id", "none")}
        if left.num_rows and right.num_rows:
            q = left.to_pylist()[0]
            rows = sorted(right.to_pylist(), key=lambda r: (-r["longest"], r["block"]))
            width = max(q["q_dim"], *(r["dim"] for r in rows))
            queries, places = _matrix(q["q_vectors"], q["q_n"], q["q_dim"], width), np.frombuffer(q["q_places"], np.int64)
            best = Best(q["q_n"], k, np.frombuffer(q["q_thresholds"], np.int64).copy())
            for r in rows:
                ids = np.where(np.frombuffer(r["nulls"], bool), _LAST, np.frombuffer(r["ids"], np.int64))
                search(queries, places, Bucket(_matrix(r["vectors"], r["n"], r["dim"], width), ids, (r["block"] << 17) + np.arange(r["n"])), best)
            found = {"place": places[best.query], "query_id": np.frombuffer(q["q_ids"], np.int64)[best.query], "score": best.score, "vec_id": best.id, "none": best.id == _LAST}
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        return pa.table([pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True)], list(found))

    both = asked.groupBy("q_block", "run").cogroup(buckets.groupBy("q_block", "run"))
    return both.applyInArrow(run, "place long, query_id long, score long, vec_id long, none boolean")


def _listed(values: list, kind: str) -> Column:
    """An array of constants, as one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _paired(query_blocks: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each block of queries once for each run that is long enough for its least need, each bucket once for each such block of queries."""
    needs = query_blocks.select("need", "q_block").collect()  # one number for each block of queries
    longest = buckets.groupBy("run").agg(F.max("longest").alias("l")).collect()  # and one for each run of buckets
    needs, longest = sorted((float(r[0]), r[1]) for r in needs), sorted(((float(r[1]), r[0]) for r in longest), reverse=True)
    enough = F.size(F.filter(_listed([n for n, _ in needs], "double"), lambda n: n <= F.col("_l")))
    of_runs = F.size(F.filter(_listed([x for x, _ in longest], "double"), lambda x: x >= F.col("need")))
    asked = query_blocks.withColumn("run", F.explode(F.slice(_listed([r for _, r in longest], "long"), F.lit(1), of_runs)))
    run_length = F.element_at(F.map_from_arrays(_listed([r for _, r in longest], "long"), _listed([x for x, _ in longest], "double")), F.col("run"))
    met = buckets.withColumn("_l", run_length).withColumn("q_block", F.explode(F.slice(_listed([q for _, q in needs], "long"), F.lit(1), enough))).drop("_l")
    return asked, met


def _asked(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """The rows of blocks whose id is divisible by `every`."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, known = np.frombuffer(r["ids"], np.int64), ~np.frombuffer(r["nulls"], bool)
            at = np.flatnonzero(known & (ids % every == 0))
            values = np.frombuffer(r["vectors"], np.int64).reshape(r["n"], r["dim"])[at]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * r["dim"]), pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array((r["block"] << 17) + at), pa.array(ids[at]), lists], ["place", "query_id", "vector"])


def _query_blocks(asked: DataFrame, each: int = 256) -> DataFrame:
    """asked(place, query_id, vector, threshold, need) in blocks of one dimension, those of the least need first."""
    names = ["q_block", "q_n", "q_dim", "need", "q_ids", "q_places", "q_thresholds", "q_vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            at = 0
            while at < batch.num_rows:
                dim = int(sizes[at])
                end = at + min(each, max(1, BLOCK // dim))
                end = at + int(np.argmax(np.append(sizes[at:end] != dim, True)))
                part = batch.slice(at, end - at)
                blobs = [part.column(c).to_numpy().astype("<i8").tobytes() for c in ("query_id", "place", "threshold")] + [part.column("vector").flatten().to_numpy().astype("<i8").tobytes()]
                need = float(part.column("need").to_numpy().min())
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([end - at], pa.int32()), pa.array([dim], pa.int32()), pa.array([need]), *[pa.array([b]) for b in blobs]], names)
                number += 1
                at = end

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.repartitionByRange(max(1, min(parts, asked.count() // each)), "need", "place").sortWithinPartitions("need", "place")
    return dealt.mapInArrow(run, "q_block long, q_n int, q_dim int, need double, q_ids binary, q_places binary, q_thresholds binary, q_vectors binary")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc("score"), "none", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: of each vector whose id is divisible by `every` the k others of the greatest inner products.

    vectors(id: long, vector: array<long>; null: takes no part). Pairs of a block of queries and a run of buckets meet in an exchange; which
    pairs there are is told from one number for each block of queries and one for each run."""
    spark = vectors.sparkSession
    runs = F.shiftrightunsigned("block", 24) * (1 << 24) + F.floor(F.col("block").bitwiseAND((1 << 24) - 1) / RUN)
    table = stored(blocks(vectors.where("vector is not null").select("id", "vector")).withColumn("run", runs.cast("long")), "vector-blocks")
    numbers = [r[0] for r in table.select("block", "longest").orderBy(F.desc("longest"), "block").limit(RUN).collect()]  # one run
    if not numbers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = stored(table.drop("run").mapInArrow(lambda batches: _asked(batches, every), "place long, query_id long, vector array<long>"), "vector-queries")

    ahead, later = F.col("block").isin(numbers), ~F.col("block").isin(numbers)
    all_ask = stored(_query_blocks(asked.withColumns({"threshold": F.lit(-_LAST), "need": F.lit(_NONE)})), "vector-asked")
    opened = stored(_searched(*_paired(all_ask, table.where(ahead).withColumn("run", F.lit(-1).cast("long"))), k), "vector-first")

    kth = _ranked(opened, k).where(F.col("rank") == k).select("place", F.col("score").alias("threshold"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    known = asked.join(kth, "place", "left").withColumn("threshold", F.coalesce("threshold", F.lit(-_LAST)))
    least = F.col("threshold") - F.abs("threshold") * 1e-9
    need = F.when(F.col("threshold") == -_LAST, _NONE).when(length > 0, least / length).when(F.col("threshold") > 0, -_NONE).otherwise(_NONE)
    query_blocks = stored(_query_blocks(known.withColumn("need", need)), "vector-asked")
    found = _searched(*_paired(query_blocks, table.where(later)), k)
    out = _ranked(opened.unionByName(found), k)
    return out.select("query_id", "rank", F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score")

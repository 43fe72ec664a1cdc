"""Near-duplicate groups by fast similarity sketching (operator 2).

A document's set is its distinct shingles of lower-cased words. Sketches are filled in rounds: each round throws every
shingle into one bin by hash, bins keep the least value of the first round that reaches them, and after `coordinates`
random rounds further rounds fill one bin each, so every coordinate is filled. Bands of coordinates propose candidates,
and links are confirmed on full sets.

Copies (equal sets) are one vertex. Within a bucket of a band all pairs are never listed: members are first compared with
one centre, and only members of different groups go on, block by block of sets. Before sets are compared, two exact bounds rule
pairs out: their sizes, and how many shingles of a set occur in no other candidate (which it shares with nobody).

Identity is by 64-bit hashes. Nulls: a null text has no set; documents without words are linked with nothing, and a null
doc_id never names a group that has another. Fewer words than a shingle: all of them are one. Repeated rows are copies. Empty table: no rows.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm import _chunks, _words
from tracequarry.llm._store import hot_keys, met, scratch, stored
from tracequarry.operators.graph import components

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def sets_of(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the range of each text."""
    return _words.unique_in_rows(*_words.Words(texts, lower=True).grams(shingle, whole=True))


def sketch(values: np.ndarray, rows: np.ndarray, coordinates: int) -> np.ndarray:
    """A row of `coordinates` values for each set; sets without elements have rows of the greatest value."""
    n = len(rows) - 1
    out = np.full((n, coordinates), _MAX)
    active = np.flatnonzero(np.diff(rows) > 0)
    filled = np.zeros((n, coordinates), bool)
    for k in range(2 * coordinates):
        if not len(active):
            break
        sizes = rows[active + 1] - rows[active]
        owner = np.repeat(active, sizes)
        at = np.arange(len(owner)) + np.repeat(rows[active] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        h = _words.mix(values[at] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bin_ = (h >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32) if k < coordinates else np.full(len(h), k - coordinates, np.uint64)
        bin_ = bin_.astype(np.int64)
        h = (np.uint64(k) << np.uint64(56)) | (_words.mix(h) >> np.uint64(8))
        new = ~filled[owner, bin_]
        cell = (owner * coordinates + bin_)[new]
        np.minimum.at(out.reshape(-1), cell, h[new])
        filled.reshape(-1)[cell] = True
        active = active[~filled[active].all(axis=1)]
    return out


def band_keys(sketches: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of consecutive coordinates."""
    n, coordinates = sketches.shape
    each = coordinates // bands
    keys = np.zeros((n, bands), np.uint64)
    for k in range(each):
        keys = _words.mix(keys * np.uint64(0x9E3779B97F4A7C15) + sketches[:, k::each][:, :bands] + np.uint64(k + 1))
    return _words.mix(keys + np.arange(1, bands + 1, dtype=np.uint64)[None, :])


def _sketched(chunks: DataFrame, kind: str, shingle: int, coordinates: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                texts = _chunks.texts_of(batch.column("payload")[r].as_py(), batch.column("sizes")[r].values.to_numpy())
                values, rows = sets_of(texts, shingle)
                n = np.diff(rows)
                total = np.concatenate(([np.uint64(0)], np.cumsum(_words.mix(values), dtype=np.uint64)))
                sid = _words.mix((total[rows[1:]] - total[rows[:-1]]) ^ _words.mix(n.astype(np.uint64))).astype(np.int64)
                keys = band_keys(sketch(values, rows, coordinates), bands).astype(np.int64)
                offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), batch.column("chunk")[r].as_py())), pa.array(np.arange(len(n), dtype=np.int32)), batch.column("rows")[r].values.field("doc_id"), pa.array(n), pa.array(sid), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))],
                    ["chunk", "at", "doc_id", "n", "sid", "keys"],
                )

    return chunks.mapInArrow(run, f"chunk long, at int, doc_id {kind}, n long, sid long, keys array<long>")


def _sets(chunks: DataFrame, active: DataFrame, shingle: int) -> DataFrame:
    """One row per chunk: the sets (sids, sizes, hashes) of its active documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = pa.array(right.column("at").to_numpy() if right.num_rows and left.num_rows else [], pa.int64())
        if not len(at):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int64())), pa.array([], pa.binary())], ["chunk", "sids", "sizes", "hashes"])
        texts = _chunks.texts_of(left.column("payload")[0].as_py(), left.column("sizes")[0].values.to_numpy()).take(at)
        values, rows = sets_of(texts, shingle)
        one = lambda x: pa.array([x], pa.list_(pa.int64()))
        return pa.table([left.column("chunk").slice(0, 1), one(right.column("sid").to_numpy()), one(np.diff(rows)), pa.array([values.tobytes()])], ["chunk", "sids", "sizes", "hashes"])

    both = chunks.select("chunk", "payload", "sizes").groupBy("chunk").cogroup(active.select(F.col("chunk").alias("of"), "at", "sid").groupBy("of"))
    return both.applyInArrow(run, "chunk long, sids array<long>, sizes array<long>, hashes binary")


def _alone(sets: DataFrame) -> DataFrame:
    """(sid, n, u): of each set its size and how many of its shingles no other active set has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, counts = np.unique(np.frombuffer(batch.column("hashes")[row].as_py(), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column("chunk")[row].as_py())), pa.array(own), pa.array(counts >= 2)], ["chunk", "value", "twice"])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes = left.column("sizes")[0].values.to_numpy()
        shared = _chunks.among(np.frombuffer(left.column("hashes")[0].as_py(), np.int64), right.column("value").to_numpy())
        upto = np.concatenate(([0], np.cumsum(~shared)))[np.concatenate(([0], np.cumsum(sizes)))]
        return pa.table([left.column("sids")[0].values, pa.array(sizes), pa.array(np.diff(upto).astype(np.int64))], ["sid", "n", "u"])

    answers = _chunks.recurring(sets.mapInArrow(send, "chunk long, value long, twice boolean"))
    return _chunks.per_chunk(sets, answers).applyInArrow(count, "sid long, n long, u long")


def _each_set(sets: DataFrame) -> DataFrame:
    """A row for each set: sid and its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                blob = batch.column("hashes")[row].as_py()
                ends = np.cumsum(batch.column("sizes")[row].values.to_numpy()) * 8
                yield pa.RecordBatch.from_arrays([batch.column("sids")[row].values, pa.array([blob[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary())], ["sid", "hashes"])

    return sets.mapInArrow(run, "sid long, hashes binary")


def _could(n: Column, u: Column, m: Column, v: Column, percent: int) -> Column:
    """Whether sets of sizes n and m, with u and v shingles that nobody else has, can reach the similarity."""
    most = F.least(n - u, m - v)
    return 100 * most >= percent * (n + m - most)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    each = _each_set(sets)
    joined = pairs.join(each.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a").join(each.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _shared(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each set of x shares with each of y, in strips of the elements of x."""
    every = np.unique(np.concatenate(x))

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(sets)
        column = np.minimum(np.searchsorted(every, values), len(every) - 1)
        hit = every[column] == values
        column, row = column[hit], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(column, kind="stable")
        return column[order], row[order]

    (cx, rx), (cy, ry) = entries(x), entries(y)
    out = np.zeros((len(x), len(y)), np.float32)
    for start in range(0, len(every), width):
        sx, sy = (slice(*np.searchsorted(c, (start, start + width))) for c in (cx, cy))
        if sx.stop > sx.start and sy.stop > sy.start:
            a, b = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
            a[rx[sx], cx[sx] - start] = 1
            b[ry[sy], cy[sy] - start] = 1
            out += a @ b.T
    return out


#: Sets in a block of either side.
X_BLOCK, Y_BLOCK = 128, 512


def _met_in_blocks(vertices: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a family (a bucket) outside its main part and its members of other parts; one for each part that a member is linked to.

    vertices: family, sid, part, asks and answers (on which sides the member stands), out and all (how many ask and answer). A group of rows holds one block of either side, or some small families; no pairs are listed."""
    few = max(1, -(-(vertices.where(f"out <= {X_BLOCK} and all <= {Y_BLOCK}").count()) // 2048))
    nx, ny = F.ceil(F.col("out") / X_BLOCK).cast("int"), F.ceil(F.col("all") / Y_BLOCK).cast("int")
    small = (F.col("out") <= X_BLOCK) & (F.col("all") <= Y_BLOCK)
    with_sets = vertices.join(_each_set(sets), "sid").withColumn("group", F.when(small, F.pmod(F.xxhash64("family"), F.lit(few)) - few).otherwise(F.col("family")))
    deal = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    x = with_sets.where("asks").select("group", "family", "sid", "part", "hashes", deal(nx).alias("xb"), every(ny).alias("yb"))
    y = with_sets.where("answers").select(F.col("group").alias("of"), F.col("family").alias("other_family"), F.col("sid").alias("other"), F.col("part").alias("other_part"), F.col("hashes").alias("other_hashes"), deal(ny).alias("yb"), every(nx).alias("xb"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        of, other = left.column("family").to_numpy(), right.column("other_family").to_numpy()
        for family in np.intersect1d(of, other):
            mine, theirs = left.filter(pa.array(of == family)), right.filter(pa.array(other == family))
            xs, ys = ([np.frombuffer(b, np.uint64) for b in c.to_pylist()] for c in (mine.column("hashes"), theirs.column("other_hashes")))
            both = _shared(xs, ys)
            union = np.array([len(s) for s in xs])[:, None] + np.array([len(s) for s in ys])[None, :] - both
            parts = theirs.column("other_part").to_numpy()
            linked = (100 * both >= percent * union) & (mine.column("part").to_numpy()[:, None] != parts[None, :])
            a, b = mine.column("sid").to_numpy(), theirs.column("other").to_numpy()
            for i in np.flatnonzero(linked.any(axis=1)):
                at = np.flatnonzero(linked[i])
                links += [(int(a[i]), int(b[j])) for j in at[np.unique(parts[at], return_index=True)[1]]]
        return pa.table([pa.array([p for p, _ in links], pa.int64()), pa.array([q for _, q in links], pa.int64())], ["a", "b"])

    return x.groupBy("group", "xb", "yb").cogroup(y.groupBy("of", "xb", "yb")).applyInArrow(run, "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    """(sid, least): for each end of a link the least id that links reach."""
    found = components(links.select(F.col("a").alias("source"), F.col("b").alias("target")))
    return found.select(F.col("node").alias("sid"), F.col("component").alias("least"))


def _grouped(chunks: DataFrame, kind: str, shingle: int, percent: int, coordinates: int, bands: int) -> DataFrame:
    """A row for each document: chunk, at, doc_id, n, and part, the same for all documents of a group (null: no words)."""
    sketched = stored(_sketched(chunks, kind, shingle, coordinates, bands), "near-sketches")
    vertices = sketched.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min(F.struct("chunk", "at")).alias("place"))
    entries = vertices.select("sid", "place", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = stored(entries.join(shared, "key"), "near-members")
    active = members.groupBy("sid").agg(F.first("place").alias("place")).select("sid", "place.*")
    sets = stored(_sets(chunks, active, shingle), "near-sets")
    facts = _alone(sets).where(100 * (F.col("n") - F.col("u")) >= percent * F.col("n"))
    members = stored(members.select("sid", "key").join(facts, "sid"), "near-members")

    # one centre for each bucket: the member with the fewest shingles of its own
    centre = members.groupBy("key").agg(F.min(F.struct("u", "sid", "n")).alias("c"))
    pairs = members.join(centre, "key").where((F.col("sid") != F.col("c.sid")) & _could(F.col("n"), F.col("u"), F.col("c.n"), F.col("c.u"), percent))
    pairs = stored(pairs.select(F.col("c.sid").alias("a"), F.col("sid").alias("b")).distinct(), "near-pairs")
    # a centre of many pairs meets them in blocks, so that its set is sent once for each block and not with each pair
    many = pairs.groupBy("a").agg(F.count("*").alias("out")).where(F.col("out") > X_BLOCK)
    star = lambda sid, asks: ("a as family", f"{sid} as sid", f"{int(asks)}L as part", f"{asks} as asks", f"not {asks} as answers", "out", "1L as all")
    stars = pairs.join(many, "a").selectExpr(*star("b", True)).unionByName(many.selectExpr(*star("a", False)))
    by_blocks = _met_in_blocks(stored(stars, "near-stars"), sets, percent)
    links = stored(_confirmed(pairs.join(many, "a", "left_anti"), sets, percent).unionByName(by_blocks), "near-links")

    # members outside the largest group of their bucket meet all that are not of their own group
    labels = _labels(links)
    grouped = stored(members.join(labels, "sid", "left").select("key", "sid", F.coalesce("least", "sid").alias("part")), "near-parts")
    by_part = grouped.groupBy("key", "part").agg(F.count("*").alias("m"))
    mixed = by_part.groupBy("key").agg(F.count("*").alias("k"), F.min("part").alias("b")).where("k > 1").select("key", "b")
    grouped = stored(grouped.join(mixed, "key"), "near-mixed")

    # a family is a mixed bucket; of buckets with the same members, which several bands of near copies make, one is enough
    hashed = lambda salt: F.bit_xor(F.xxhash64("sid", F.lit(salt)))
    same = grouped.groupBy("key").agg(F.count("*").alias("m"), hashed(1).alias("x"), hashed(2).alias("y")).groupBy("m", "x", "y").agg(F.min("key").alias("key"))
    vertices = stored(grouped.join(same.select("key"), "key", "left_semi").select(F.col("key").alias("family"), "sid", "part"), "near-families")
    sizes = vertices.groupBy("family", "part").agg(F.count("*").alias("m")).groupBy("family").agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("all"))
    sizes = stored(sizes.select("family", F.col("top.part").alias("main"), "all", (F.col("all") - F.col("top.m")).alias("out")), "near-sizes")
    vertices = met(vertices, sizes, "family", hot_keys(vertices, "family")).withColumn("asks", F.col("part") != F.col("main")).withColumn("answers", F.lit(True))
    more = stored(_met_in_blocks(stored(vertices, "near-vertices"), sets, percent), "near-links")
    if not more.isEmpty():
        labels = _labels(links.unionByName(more))
    placed = sketched.select("chunk", "at", "doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    return placed.join(labels, "sid", "left").select("chunk", "at", "doc_id", "n", F.coalesce("least", "sid").alias("part"))


def groups(documents: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = 100, bands: int = 25) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of its group) and kept of every row."""
    with scratch(documents.sparkSession):
        chunks = stored(_chunks.chunked(documents.select("doc_id", "text")), "near-chunks")
        kind = documents.schema["doc_id"].dataType.simpleString()
        grouped = stored(_grouped(chunks, kind, shingle, percent, coordinates, bands), "near-groups", keep=True)
        least = stored(grouped.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("first")), "near-least", keep=True)
        out = met(grouped, least, "part", hot_keys(grouped, "part"), "left").withColumn("component_id", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("first")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(documents: DataFrame, **how) -> DataFrame:
    """documents with one row of each group, that of the least doc_id; documents without words all stay."""
    how = {"shingle": 5, "percent": 80, "coordinates": 100, "bands": 25} | how
    with scratch(documents.sparkSession):
        chunks = stored(_chunks.chunked(documents), "near-chunks", keep=True)
        grouped = stored(_grouped(chunks, documents.schema["doc_id"].dataType.simpleString(), **how), "near-groups", keep=True)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk", "at")
    kept = grouped.where("part is not null").groupBy("part").agg(F.min(place).alias("p")).select("p.chunk", "p.at")
    kept = kept.unionByName(grouped.where("part is null").select("chunk", "at"))
    order, inner = documents.columns, [f for f in documents.schema.fields if f.name != "text"]
    schema = type(documents.schema)([documents.schema["text"].__class__("row", type(documents.schema)(inner)), documents.schema["text"]])

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        at = pa.array(np.sort(right.column("at").to_numpy()) if right.num_rows else [], pa.int64())
        texts = _chunks.texts_of(left.column("payload")[0].as_py(), left.column("sizes")[0].values.to_numpy())
        return pa.table([left.column("rows")[0].values.take(at), texts.take(at).cast(pa.string())], ["row", "text"])

    out = _chunks.per_chunk(chunks, kept).applyInArrow(take, schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in order])

"""Quality classifier by attention over passages (operator 8).

A text is a bag of passages of 128 words. Each passage is encoded (shares of byte values, word lengths, how much of it
repeats), learned gated attention weighs the passages, and the weighted sum is scored; only documents have labels.

The fit runs on the driver with at most `rows` labelled rows (a parameter), picked by a hash; whole texts are encoded, and
every document is scored. The encoded passages come to the driver part by part into a file of its temp folder, and the fit
reads them by mini-batches, so its memory does not grow with the length or the copies of texts.

Nulls: null texts are like empty ones, one passage without words; label rows without a label or doc_id are not learned
from; of several labels of a document the highest counts, of several rows of a labelled doc_id the least text is learned from. Without labels every score is 0.5. Empty table: no rows.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm import _store, _words

PASSAGE = 128
#: So many passages are sent to the driver in a row, and worked on at once by the fit.
SENT, AT_ONCE = 1024, 8192
#: Bytes are counted by value, those from 127 on together.
_CLASSES = np.minimum(np.arange(256), 127)
FEATURES = 128 + 5


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the range of passages of each text; texts without words have one passage."""
    w = _words.Words(texts, lower=False)
    n = w.counts()
    many = np.maximum(-(-n // PASSAGE), 1)
    rows = np.concatenate(([0], np.cumsum(many)))
    inside = np.arange(len(w.hashes)) - np.repeat(w.rows[:-1], n)
    passage = np.repeat(rows[:-1], n) + inside // PASSAGE
    sizes = np.bincount(passage, minlength=rows[-1])
    # a byte belongs to the passage of the word that it stands in or follows
    lead = np.searchsorted(w.starts, np.arange(len(w.data)), "right") - 1
    row_of = np.repeat(np.arange(len(n)), np.diff(w.offsets))
    at = rows[:-1][row_of] if len(row_of) else np.zeros(0, np.int64)
    if len(passage):
        own = passage[np.maximum(lead, 0)]
        at = np.where((lead >= 0) & (own >= at), own, at)
    x = np.zeros((rows[-1], FEATURES), np.float32)
    shares = np.bincount(at * 128 + _CLASSES[w.data], minlength=rows[-1] * 128).reshape(-1, 128)
    x[:, :128] = shares / np.maximum(shares.sum(axis=1, keepdims=True), 1)
    distinct = np.diff(_words.unique_in_rows(w.hashes, np.concatenate(([0], np.cumsum(sizes))))[1])
    grams, ranges = w.grams(3, whole=True)
    fresh = np.diff(_words.unique_in_rows(grams, ranges)[1]) / np.maximum(np.diff(ranges), 1)
    x[:, 128] = distinct / np.maximum(sizes, 1)
    x[:, 129] = np.repeat(fresh, many)
    x[:, 130] = np.bincount(passage, w.ends - w.starts, rows[-1]) / np.maximum(sizes, 1) / 10
    x[:, 131] = np.log1p(sizes)
    x[:, 132] = np.repeat(np.log1p(n), many)
    return x, rows


@dataclass
class Model:
    """Weights of the encoder (w, b), gated attention (v, u, a) and scorer (c, d); features are centred and scaled first."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        p, starts, many = self.p, rows[:-1], np.diff(rows)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), many))
        alpha = e / np.repeat(np.add.reduceat(e, starts), many)
        z = np.add.reduceat(alpha[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradients(self, f: dict[str, np.ndarray], rows: np.ndarray, labels: np.ndarray, of: int | None = None) -> dict[str, np.ndarray]:
        """Of the mean loss over `of` bags, by default those given."""
        p, starts, many = self.p, rows[:-1], np.diff(rows)
        off = (f["y"] - labels) / (of or len(labels))
        dz = np.repeat(off[:, None] * p["c"], many, axis=0)
        dalpha = (f["h"] * dz).sum(axis=1)
        de = f["alpha"] * (dalpha - np.repeat(np.add.reduceat(f["alpha"] * dalpha, starts), many))
        dtg = de[:, None] * p["a"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["alpha"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ off, "d": np.array(off.sum())}

    def gradients_of_long(self, parts: list[np.ndarray], label: float, of: int) -> dict[str, np.ndarray]:
        """As gradients for one bag given in parts: a pass for its weighted sum, a pass for the gradients."""
        p, greatest, total, z = self.p, -np.inf, 0.0, 0.0
        for part in parts:
            f = self.forward(np.asarray(part, np.float64), np.array([0, len(part)]))
            e = (f["t"] * f["g"]) @ p["a"]
            new = max(greatest, e.max())
            w = np.exp(e - new)
            total, z, greatest = total * np.exp(greatest - new) + w.sum(), z * np.exp(greatest - new) + w @ f["h"], new
        z = z / total
        off = (1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30))) - label) / of
        dz, out = off * p["c"], {"c": z * off, "d": np.array(off)}
        for part in parts:
            f = self.forward(np.asarray(part, np.float64), np.array([0, len(part)]))
            h, t, g = f["h"], f["t"], f["g"]
            alpha = np.exp((t * g) @ p["a"] - greatest) / total
            de = alpha * (h @ dz - z @ dz)
            dtg = de[:, None] * p["a"]
            dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
            dh = (alpha[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h**2)
            for k, v in {"w": f["x"].T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de}.items():
                out[k] = out.get(k, 0) + v
        return out


def batch_gradients(model: Model, x: np.ndarray, rows: np.ndarray, labels: np.ndarray, bags: np.ndarray, at_once: int = AT_ONCE) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over `bags`, from at most `at_once` passages of x at a time."""
    total: dict[str, np.ndarray] = {}
    many = rows[bags + 1] - rows[bags]
    begin = 0
    while begin < len(bags):
        end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(many[begin:]), at_once, "right")))
        some = bags[begin:end]
        if many[begin] > at_once:
            a, b = rows[some[0]], rows[some[0] + 1]
            grads = model.gradients_of_long([x[i : min(i + at_once, b)] for i in range(a, b, at_once)], labels[some[0]], len(bags))
        else:
            own = np.concatenate([np.arange(rows[b], rows[b + 1]) for b in some])
            part = np.concatenate(([0], np.cumsum(many[begin:end])))
            grads = model.gradients(model.forward(np.asarray(x[own], np.float64), part), part, labels[some], len(bags))
        total = {k: total[k] + g for k, g in grads.items()} if total else grads
        begin = end
    return total


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the columns, part by part."""
    cut = range(0, len(x), AT_ONCE)
    mean = sum(x[i : i + AT_ONCE].sum(axis=0, dtype=np.float64) for i in cut) / len(x)
    return mean, np.sqrt(sum(((x[i : i + AT_ONCE] - mean) ** 2).sum(axis=0) for i in cut) / len(x))


def fit(x: np.ndarray, rows: np.ndarray, labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 8) -> Model:
    """Stochastic gradient descent with adaptive moments on the log loss of the bags."""
    rng = np.random.default_rng(seed)
    start = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    mean, deviation = moments(x)
    model = Model(mean, deviation + 1e-3, {"w": start(x.shape[1], hidden), "b": np.zeros(hidden), "v": start(hidden, attention), "u": start(hidden, attention), "a": start(attention), "c": start(hidden), "d": np.zeros(())})
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for bags in np.array_split(order, max(1, len(order) // batch)):
            grads = batch_gradients(model, x, rows, labels, bags)
            step += 1
            for k, g in grads.items():
                g = g + decay * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (0.97**epoch) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learned(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 6000) -> Model | None:
    """A model of at most `rows` labelled documents, those with the lowest hashes of their doc_id."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch):
                x, ranges = encoded(part.column("text"))
                cuts = [(i, p, x[at : min(at + SENT, b)].tobytes()) for i, (a, b) in enumerate(zip(ranges, ranges[1:], strict=False)) for p, at in enumerate(range(a, b, SENT))]
                for c in range(0, len(cuts), 32):
                    rows_of, number, blobs = zip(*cuts[c : c + 32], strict=True)
                    own = pa.array(rows_of, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(own), part.column("label").take(own), pa.array(number, pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "label", "part", "x"])

    kinds = (documents.schema["doc_id"].dataType.simpleString(), given.schema["label"].dataType.simpleString())
    # one row of each labelled doc_id, so at most `rows` bags; copies are met within their tasks first
    one = documents.select("doc_id", "text").join(F.broadcast(given), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    bags = _store.stored(one.mapInArrow(run, f"doc_id {kinds[0]}, label {kinds[1]}, part int, x binary"), "bags")
    many, labelled, last = [], [], None
    with tempfile.TemporaryDirectory(prefix="bags-") as folder:
        path = os.path.join(folder, "x")
        with open(path, "wb") as file:
            dealt = bags.repartitionByRange(max(8, _store.size_of(bags, "x") >> 22), "doc_id", "part").sortWithinPartitions("doc_id", "part")
            for r in dealt.toLocalIterator():  # one partition of a few MB at a time
                if not many or r["doc_id"] != last:
                    many.append(0)
                    labelled.append(float(r["label"] > 0))
                    last = r["doc_id"]
                many[-1] += len(r["x"]) // (4 * FEATURES)
                file.write(r["x"])
        if not many:
            return None
        x = np.memmap(path, np.float32, "r", shape=(sum(many), FEATURES))
        return fit(x, np.concatenate(([0], np.cumsum(many))), np.array(labelled))


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch):
                if model is None:
                    scores = np.full(part.num_rows, 0.5)
                else:
                    x, rows = encoded(part.column("text"))
                    scores = model.forward(x.astype(np.float64), rows)["y"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")

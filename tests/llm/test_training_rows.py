"""The classifier's fit counts documents, not copies of them, and works on long bags part by part."""

import numpy as np
import pyarrow as pa

from tracequarry.llm import attention


def test_copies_of_a_labelled_document_are_one_training_row(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a copy of many")] * 50 + [(1, None), (2, "other " * 300), (3, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(attention, "SENT", 2)
    monkeypatch.setattr(attention, "fit", lambda x, rows, y: seen.update(x=np.array(x), rows=list(rows), labels=list(y)))
    attention.learned(docs, labels, rows=4)
    assert seen["rows"] == [0, 1, 4, 5] and seen["labels"] == [1, 0, 0]
    want = attention.encoded(pa.array(["a copy of many", "other " * 300, None]))[0]
    assert np.array_equal(seen["x"], want)


def test_gradients_in_parts_equal_those_of_the_whole():
    rng = np.random.default_rng(3)
    rows = np.array([0, 3, 20, 21, 30])
    x, y = rng.normal(size=(30, attention.FEATURES)), np.array([1.0, 0, 1, 0])
    model = attention.fit(x, rows, y, hidden=4, attention=3, epochs=1, seed=1)
    mean, deviation = attention.moments(x)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(deviation, x.std(axis=0))
    want = model.gradients(model.forward(x, rows), rows, y)
    for at_once in (1, 4, 9, 100):
        got = attention.batch_gradients(model, x, rows, y, np.arange(4), at_once)
        assert all(np.allclose(got[k], want[k]) for k in want)

"""As-of joins of keys with many rows, dealt into ranges of time, against plain search."""

import datetime
import random

import pytest

from tracequarry.operators import evidence


@pytest.mark.parametrize("kind", ["int", "timestamp", "date", "string"])
@pytest.mark.parametrize("many", [10, 1 << 20])
def test_as_of(spark, monkeypatch, kind, many):
    monkeypatch.setattr(evidence, "MANY", many)
    monkeypatch.setattr(evidence, "RANGES", 7)
    rng = random.Random(2)
    day = datetime.datetime(2024, 1, 1)
    value = {"int": lambda n: n, "timestamp": lambda n: day + datetime.timedelta(hours=n), "date": lambda n: (day + datetime.timedelta(days=n)).date(), "string": lambda n: f"{n:04d}"}[kind]
    time = lambda: None if rng.random() < 0.05 else value(rng.choice([rng.randrange(200), 50]))
    key = lambda: rng.choice(["hot", "hot", "hot", "cold", None])
    left = [(i, key(), time()) for i in range(300)]
    right = [(key(), time(), rng.choice([None, rng.randrange(99)])) for _ in range(120)] + [("late", value(150), 1)]
    want = {}
    for i, k, t in left:
        seen = [(u, v is not None, v) for c, u, v in right if c == k and k is not None and t is not None and u is not None and u <= t]
        want[i] = max(seen, key=lambda s: (s[0], s[1], s[2] or 0))[2] if seen else None
    a = spark.createDataFrame(left, f"id int, k string, ts {kind}")
    b = spark.createDataFrame(right, f"k string, other_ts {kind}, v int")
    got = evidence.as_of(a, b, ["k"]).collect()
    assert len(got) == 300 and {r["id"]: r["v"] for r in got} == want
    assert evidence.as_of(a.limit(0), b, ["k"]).count() == 0 and evidence.as_of(a, b.limit(0), ["k"]).where("v is not null").count() == 0

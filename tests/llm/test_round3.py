"""Spelling variants, greatest inner products and the audit of filters against plain versions of themselves."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracequarry.llm import audit, innerproducts, spelling

# ---- spelling variants


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows, least=6, often=5):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= often}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, times=5):
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= times * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n, len(near[w]), words[f] if f else None))
    return out


def spelled_rows():
    rng = random.Random(8)
    letters, base = "abcdefgàé÷ÿß", []
    for _ in range(60):
        base.append("".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 8, 9]))))
    words = list(base)
    for w in base:
        for _ in range(6):
            k, v = rng.randrange(len(w)), rng.choice(letters)
            words.append(rng.choice([w[:k] + v + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + v + w[k:], "".join(rng.sample(w, len(w)))]))
    words += ["x" * 400, "x" * 401, "x" * 399 + "y", "abcdef", "abcdefg", "abcdfe"]
    out = []
    for d in range(400):
        out.append((d if d % 50 else None, " ".join(rng.choice([x, x.upper()]) for x in rng.choices(words, weights=[1 + 40 * (i % 7 == 0) for i in range(len(words))], k=40))))
    return out + [(1, None), (2, ""), (3, "  \n"), (4, "mañanałmañana \U0001f600mañana.mañana-Mañana"), out[5], out[5]]


def test_variants(spark, monkeypatch):
    rows = spelled_rows()
    want = plain_variants(counted(rows))
    assert len(want) > 100 and sum(1 for w in want if w[1]) > 10
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    assert {tuple(r) for r in spelling.variants(docs).collect()} == want
    # the same over many small leaves, blocks and sums
    for name, value in (("LEAF", 20), ("POINTS", 4), ("BLOCK", 2000), ("ASKING", 16)):
        monkeypatch.setattr(spelling, name, value)
    assert {tuple(r) for r in spelling.variants(docs, sample=150).collect()} == want
    assert spelling.variants(docs.limit(0)).count() == 0


def test_tree_reaches_all_within_one_up_and_one_down():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 4, (500, spelling.COUNTS)) * (rng.random((500, spelling.COUNTS)) < 0.1)
    asking = np.maximum(points[:100] + rng.integers(-1, 2, (100, spelling.COUNTS)) * (rng.random((100, spelling.COUNTS)) < 0.03), 0)
    tree = spelling.Tree(points, 8)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(500))
    for up, down in ((1, 1), (1, 0), (0, 0)):
        reached = {(q, p) for leaf, own in tree.reached(asking, up, down) for q in own.tolist() for p in tree.leaves[leaf].tolist()}
        gap = points[None] - asking[:, None]
        near = (np.maximum(gap, 0).sum(2) <= up) & (np.maximum(-gap, 0).sum(2) <= down)
        assert {(int(q), int(p)) for q, p in zip(*np.nonzero(near))} <= reached
        assert len(reached) < 0.6 * 500 * 100


# ---- greatest inner products


def plain_top(rows, every, k):
    out = []
    for i, (q, v) in enumerate(rows):
        if v is None or q is None or q % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), c is None, c) for j, (c, w) in enumerate(rows) if j != i and w is not None]
        scored.sort(key=lambda s: (s[0], s[1], s[2] if s[2] is not None else 0))
        out += [(q, n + 1, c, -s) for n, (s, _, c) in enumerate(scored[:k])]
    return sorted(out, key=str)


def vector_rows():
    rng = random.Random(6)
    rows = [(i, [rng.randrange(-300, 300) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [40 * (1 + i % 3), 5, 0, 0, 0, i % 2]) for i in range(60)]  # ties
    rows += [(400 + i, [7, 7, 7, 7, 7, 7]) for i in range(40)]  # copies
    rows += [(450, [0] * 6), (455, [0] * 6), (460, None), (465, [900, 1]), (466, [1] * 9), (None, [800] * 6), (470, [1 << 30, -(1 << 30), 3, 4, 5, 6])]
    return rows + [rows[5], rows[10], (10, [1, 2, 3, 4, 5, 6])]


@pytest.mark.parametrize("small", [False, True])
def test_top_products(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(innerproducts, "BLOCK", 60)
        monkeypatch.setattr(innerproducts, "RUN", 2)
        monkeypatch.setattr(innerproducts, "WORTH", 1)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    got = sorted(map(tuple, innerproducts.top_products(df, every=5, k=4).collect()), key=str)
    assert got == plain_top(rows, 5, 4)
    few = df.where("id in (0, 5)").dropDuplicates(["id"])
    assert innerproducts.top_products(few, every=5, k=4).count() == 2
    assert innerproducts.top_products(df.limit(0)).count() == 0


def test_both_prunings_are_used_and_exact(monkeypatch):
    monkeypatch.setattr(innerproducts, "WORTH", 2)
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-20, 20, (4000, 8)), np.eye(8, dtype=np.int64)[rng.integers(0, 8, 400)] * 500 + rng.integers(-5, 5, (400, 8))]).astype(np.int64)
    queries = rows[4000:4040]
    best = innerproducts.Best(40, 5, np.full(40, -innerproducts._LAST))
    seen = Counter()
    for start in range(0, len(rows), 1100):
        part = np.arange(start, min(start + 1100, len(rows)))[::-1]
        seen.update(innerproducts.search(queries, np.arange(4000, 4040), innerproducts.Bucket(rows[part], part.astype(np.int64), part.astype(np.int64)), best))
    assert seen["length"] and seen["coordinate"] and seen["length"] + seen["coordinate"] < 40 * len(rows)
    score = queries @ rows.T
    score[np.arange(40), np.arange(4000, 4040)] = -(10**9)
    for q in range(40):
        order = sorted(range(len(rows)), key=lambda r: (-score[q, r], r))[:5]
        assert best.id[best.query == q].tolist() == order and best.score[best.query == q].tolist() == score[q, order].tolist()


def test_quantised(spark):
    rows = [([0.5, -0.001953125, 0.00390625],), (None,), ([],), ([1.0, None],), ([float("nan")],), ([float("-inf")],), ([-0.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(innerproducts.quantised(df["v"])).collect()] == [[128, -1, 1], None, None, None, None, None, [0]]


# ---- audit of filters


def plain_audit(docs, labels):
    marks = {}
    for d, quality, toxic in labels:
        g, t = marks.get(d, (False, False))
        marks[d] = (g or quality == 1, t or toxic == 1)
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = []
    for d, text, part in docs:
        t, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and d > least[t],
        }
        rows.append((part or "", fails, *(marks.get(d, (False, False)) if d is not None else (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        sums, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                sums[f] += len(gone)
                failing = sum(r[1][f] for r in own)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                lines.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        out += [(*x[:-1], sums[x[-1]]) for x in lines]
    return sorted(out)


def test_audit(spark, rows):
    rng = random.Random(3)
    docs = [(r[0], r[1], r[2]) for r in rows]
    long = " ".join("w%d" % i for i in range(120))
    docs += [(900, long, "fr"), (901, long, "en"), (900, long, None), (902, long.upper(), "en"), (903, long + " #", "en"), (None, long, "en"), (950, long.replace("w", "W", 40), "")]
    labels = [(d, rng.randrange(2), rng.randrange(2)) for d, _, _ in docs if d is not None and rng.random() < 0.6] + [(900, 0, None), (900, 1, 1), (None, 1, 1), (12345, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, lang string, digest string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, audit.audited(frame, marks).collect()))
    assert got == plain_audit(docs, labels)
    assert audit.audited(frame.limit(0), marks).count() == 0
    assert audit.audited(frame, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_walk_stores_what_survives_each_subset():
    rng = np.random.default_rng(5)
    for k in (1, 2, 5):
        cells = rng.integers(0, 50, (3, 1 << k, 2))
        states = audit.walk(cells)
        for subset in range(1 << k):
            keep = [m for m in range(1 << k) if m & subset == 0]
            assert (states[:, subset] == cells[:, keep].sum(axis=1)).all()

"""Near duplicates, repeated passages, fingerprints, packing, scores and the classifier against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracequarry.llm import _chunks, attention, fingerprints, lattice, neardup, packing, repeats
from tracequarry.llm._store import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_groups(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    return part, sets


@pytest.mark.parametrize("k", [4, 5])
def test_groups(documents, rows, k):
    part, sets = brute_groups(rows, k, 80)
    least = {}
    for p, r in zip(part, rows):
        if r[0] is not None:
            least[p] = min(least.get(p, r[0]), r[0])
    want = collections.Counter((r[0], len(s), least.get(p) if s else r[0], r[0] == (least.get(p) if s else r[0])) for p, r, s in zip(part, rows, sets))
    got = collections.Counter(tuple(r) for r in neardup.groups(documents, shingle=k).collect())
    assert got == want


def test_blocks_and_pairs_agree(spark):
    """A group of near copies around the threshold, met in blocks, against brute force."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    part, _ = brute_groups(rows, 4, 80)
    least = {p: min(i for i, q in enumerate(part) if q == p) for p in part}
    assert got == {i: least[p] for i, p in enumerate(part)}


def test_one_of_each_group_stays(documents, rows):
    part, sets = brute_groups(rows, 5, 80)
    out = neardup.deduplicated(documents)
    assert out.columns == documents.columns and out.schema == documents.schema
    kept = out.collect()
    assert len(kept) == len({p for p, s in zip(part, sets) if s}) + sum(not s for s in sets)


def test_neardup_empty(empty):
    assert neardup.groups(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def brute_repeats(rows, window):
    words = [WORD.findall(r[1] or "") for r in rows]
    counts = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield w, gone


@pytest.mark.parametrize("window", [10, 35, 50])
def test_repeats(documents, rows, window):
    out = repeats.without_repeats(documents.drop("n_words"), window=window, words_only=True)
    want = collections.Counter((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)) for r, (w, gone) in zip(rows, brute_repeats(rows, window)))
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.collect()) == want


def test_repeats_keep_other_text_as_it_was(documents, rows):
    out = repeats.without_repeats(documents, window=50).collect()
    clean = collections.Counter(r[1] or "" for r, (_, gone) in zip(rows, brute_repeats(rows, 50)) if not any(gone))
    assert collections.Counter(r["text"] for r in out if not r["n_removed"]) == clean
    by_id = {r[0]: (r[1] or "").encode() for r in rows}
    for r in out:
        raw = by_id[r["doc_id"]] if r["doc_id"] is not None else None
        if raw is not None:
            for s in sorted(r["removed"], key=lambda s: -s["start"]):
                raw = raw[: s["start"]] + raw[s["end"] :]
            assert raw.decode() == r["text"]


def test_the_automaton_decides_where_passages_are(documents, rows, monkeypatch):
    """Every occurrence of a confirmed phrase is found by the automaton, at whole words of one text; without it nothing is found."""
    texts = pa.array([r[1] for r in rows])
    passages = repeats.Passages(texts, 35)
    picked, _ = passages.picked()
    words = [WORD.findall(r[1] or "") for r in rows]
    every = [w for ws in words for w in ws]
    edges = set(np.cumsum([0] + [len(w) for w in words]).tolist())
    code = {w: passages.letters[i].tobytes() for i, w in enumerate(every)}
    wanted = set(picked[::3])
    brute = [i for i in range(len(every) - 7) if b"".join(code[w] for w in every[i : i + 8]) in wanted and not edges & set(range(i + 1, i + 8))]
    assert sorted(passages.located(repeats.automaton_of(sorted(wanted))).tolist()) == brute and brute
    assert not len(passages.located(repeats.automaton_of([])))


def test_repeats_empty(empty):
    assert repeats.without_repeats(empty).count() == 0


def test_fingerprints(documents, rows):
    with_text = [r for r in rows if r[0] is not None]
    ids = [r[0] for r in with_text]
    alone = [r for r in with_text if ids.count(r[0]) == 1]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(documents).collect()}
    assert fingerprints.edited_fingerprints(documents).count() == len(rows)
    order = sorted({r[0]: r[1] or "" for r in with_text}.items(), reverse=True)
    for (doc_id, text), (_, after) in zip(order, order[1:]):
        if doc_id in {r[0] for r in alone}:
            edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            assert got[doc_id]["n_chars"] == len(text) and got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert abs(got[doc_id]["near_edited"] - fingerprints.likeness(got[doc_id]["fingerprint"], got[doc_id]["edited_fingerprint"])) < 1e-12


def test_equal_texts_have_equal_fingerprints_and_merge(documents, spark):
    out = fingerprints.fingerprinted(documents.select("doc_id", "text")).collect()
    by = collections.defaultdict(set)
    for r in out:
        by[(r["text"] or "").translate(LOWER)].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    long = " ".join(f"w{k}" for k in range(3000))
    part = " ".join(f"w{k}" for k in range(300))
    a, b, both = (r["fingerprint"] for r in fingerprints.fingerprinted(spark.createDataFrame([(1, long), (2, part), (3, long)], "doc_id long, text string")).orderBy("doc_id").collect())
    assert fingerprints.containment(b, a) == 1.0 and fingerprints.likeness(a, both) == 1.0 and fingerprints.merged([a, b]) == a
    assert abs(fingerprints.likeness(a, b) - 0.1) < 0.05


@pytest.mark.parametrize("kind", ["string", "decimal(10,0)"])
def test_fingerprints_of_other_ids(documents, spark, kind):
    texts = documents.select("doc_id", "text").where("doc_id < 40")
    named = texts.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 5, "0") if kind == "string" else F.col("doc_id").cast(kind))
    plain = lambda df: sorted((int(r["doc_id"]), *list(r)[1:]) for r in df.collect())
    assert plain(fingerprints.edited_fingerprints(named)) == plain(fingerprints.edited_fingerprints(texts))
    least = spark.createDataFrame([(-(2**63), "a b"), (2**63 - 1, "c d"), (None, "e f")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_chars"] for r in fingerprints.edited_fingerprints(least).collect()} == {-(2**63): 3, 2**63 - 1: 3, None: 3}


def test_fingerprints_empty_and_alone(empty, spark):
    assert fingerprints.edited_fingerprints(empty).count() == 0
    (row,) = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == 7


def test_packing(documents, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(documents, path, capacity=64, end=2, keep_ids=True)
    got = out.collect()
    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r["length"] for r in got) // 64) + 2
    assert packing.sequences(out).agg(F.sum("n_tokens")).first()[0] == sum(r["length"] for r in got)


def test_encoder_agrees_with_the_tokenizer_on_odd_spaces():
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(rng.choice(["a", "b", " ", "\n", "\t", "ß", "1", "'s", "-", " ", "　", "<|endoftext|>"]) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    for _ in range(2):
        assert enc.encode(pa.array(texts)) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_encoder_of_another_pre_tokenizer_encodes_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["One  two\nThree's", "", "x<|endoftext|> y", "ß ü é"]
    assert not packing.encoder(path).by_words
    assert packing.encoder(path).encode(pa.array(texts)) == [np.array(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    for _ in range(60):
        counts = collections.Counter(min(100, int(rng.expovariate(1 / rng.choice([10, 40, 80]))) + 1) for _ in range(rng.randint(1, 400)))
        load, placed = collections.Counter(), collections.Counter()
        for length, rank, n, first, offset in packing.plan_runs(counts, 100):
            placed[length] += n
            for k in range(n):
                assert load[first + k] == offset
                load[first + k] += length
        assert placed == counts and max(load.values()) <= 100
        big = sum(n for length, n in counts.items() if length > 50)
        assert len(load) <= max(big, -(-sum(length * n for length, n in counts.items()) // 100)) * 1.25 + 1


def test_packing_empty(empty):
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab"]
    p = np.array([0.1, 0.2, 0.1, 0.1, 0.2, 0.1, 0.2])
    voc, _ = lattice.vocabulary(pieces + ["?"], np.append(p, 1e-12), np.full(256, 7))

    def brute(word):
        return 1.0 if not word else sum(q * brute(word[len(x) :]) for x, q in zip(pieces, p) if word.startswith(x))

    words = ["a", "b", "abab", "baab", "ababba"]
    half = (voc.log_p - math.log(2), voc.byte_log_p)
    for w, got, other in zip(words, *lattice.log_marginals(words, voc, half)):
        assert abs(got - math.log(brute("▁" + w))) < 1e-6 and other < got
    counts = lattice.expected(words, np.ones(len(words)), voc)
    assert np.allclose(lattice.expected(words * 2, np.full(10, 0.5), voc), counts)
    assert abs(sum(len(pieces[i]) * c for i, c in zip(lattice.vocabulary(pieces + ["?"], np.append(p, 1e-12), np.full(256, 7))[1], counts) if i < len(pieces)) - sum(len(w) + 1 for w in words)) < 1e-4


def test_long_words_agree_with_short_ones(monkeypatch):
    """Words over LONG characters are worked on one by one; the sums are the same."""
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "?"]
    voc, _ = lattice.vocabulary(pieces, np.array([0.1, 0.2, 0.1, 0.1, 0.2, 0.1, 0.2, 1e-9]), np.full(256, 7))
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(40)) for _ in range(6)]
    want, counts = lattice.log_marginals(words, voc)[0], lattice.expected(words, np.arange(6.0), voc)
    monkeypatch.setattr(lattice, "LONG", 10)
    assert np.allclose(lattice.log_marginals(words, voc)[0], want) and np.allclose(lattice.expected(words, np.arange(6.0), voc), counts)


class BruteLattice:
    """Segmentations of words in plain Python, by a table of pieces and one of bytes."""

    def __init__(self, pieces, byte_at, counts, end_p):
        heads = sum(c for x, c in zip(pieces, counts) if x.startswith("▁"))
        inner = sum(c for x, c in zip(pieces, counts) if not x.startswith("▁")) + heads
        p = [c / heads * (1 - end_p) if x.startswith("▁") else c / inner for x, c in zip(pieces, counts)]
        self.p, self.number = {x: q for x, q in zip(pieces, p) if x}, {x: i for i, x in enumerate(pieces) if x}
        self.bytes, self.stop = [p[i] for i in byte_at], math.log(heads / inner)
        self.longest = max(map(len, self.p))

    def edges(self, w):
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - self.longest), j):
                if w[i:j] in self.p:
                    yield i, j, math.log(self.p[w[i:j]]), w[i:j]
            if j > 1:
                yield j - 1, j, sum(math.log(self.bytes[b]) for b in w[j - 1].encode()), None

    def sums(self, word):
        w = "▁" + word
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)
        a, b, edges = [0.0] + [-math.inf] * len(w), [-math.inf] * len(w) + [0.0], list(self.edges(w))
        for i, j, q, _ in edges:
            a[j] = add(a[j], a[i] + q)
        for i, j, q, _ in sorted(edges, key=lambda e: -e[1]):
            b[i] = add(b[i], q + b[j])
        counts = collections.Counter()
        for i, j, q, piece in edges:
            if piece:
                counts[self.number[piece]] += math.exp(a[i] + q + b[j] - a[-1])
        return (a[-1] + self.stop) / math.log(10), counts


def test_scores(documents, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = lattice.scored(documents, path).collect()
    tokens = [WORD.findall((r[1] or "").translate(LOWER)) + [None] for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows]
    c = collections.Counter(t for ts, h in zip(tokens, held) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    pieces, scores, byte_at = lattice.read_vocabulary(path)
    start, end_p = lattice.prior(scores, pieces), c[None] / n
    own = model = BruteLattice(pieces, byte_at, start, end_p)
    for _ in range(2):
        counts = 1000 * start
        for w, times in c.items():
            if w is not None:
                for k, x in model.sums(w)[1].items():
                    counts[k] += times * x
        model = BruteLattice(pieces, byte_at, counts, end_p)
    once, twice = (sum(x == k for w, x in c.items() if w is not None) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    by_pieces, by_scores = ({w: m.sums(w)[0] for ts in tokens for w in ts if w is not None} for m in (model, own))
    mixed = {w: math.log10(max(c[w] - discount, 0) / n + 10 ** q * discount * (v - 1) / n / (1 - end_p)) for w, q in by_pieces.items() if q > -300}
    total = lambda ts, values: sum(values.get(t, -999) for t in ts if t is not None) + math.log10(end_p)
    want = sorted(
        ((str(r[0]), h, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), total(ts, by_pieces), total(ts, by_scores), total(ts, mixed)) for r, ts, h in zip(rows, tokens, held)),
        key=repr,
    )
    got = sorted(((str(r["doc_id"]), *list(r)[1:]) for r in out), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for x, y in zip(got, want):
        for a, b in zip(x[5:8], y[5:8]):
            assert abs(a - b) <= 1e-5 * max(1, abs(b))
        assert y[8] < -900 or abs(x[8] - y[8]) <= 1e-5 * max(1, abs(y[8]))


def test_scores_empty(empty):
    assert lattice.scored(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_gradients_and_learning(spark):
    rng = np.random.default_rng(0)
    x, rows = rng.normal(size=(11, attention.FEATURES)), np.array([0, 3, 4, 9, 11])
    y = np.array([1.0, 0, 1, 0])
    model = attention.fit(x, rows, y, hidden=4, attention=3, epochs=1, seed=1)
    loss = lambda: -np.mean(y * np.log(model.forward(x, rows)["y"]) + (1 - y) * np.log(1 - model.forward(x, rows)["y"]))
    grads = model.gradients(model.forward(x, rows), rows, y)
    for k, at in (("w", (5, 2)), ("v", (1, 1)), ("u", (2, 0)), ("a", (1,)), ("c", (3,)), ("b", (0,))):
        was = model.p[k][at]
        model.p[k][at] = was + 1e-5
        up = loss()
        model.p[k][at] = was - 1e-5
        down = loss()
        model.p[k][at] = was
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-6


def test_classifier_learns_and_scores_all(spark, documents, empty):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + ("!!" if i % 2 else "") for _ in range(rng.randint(5, 400)))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(160)] + [(None, 1, None), (5, None, 3)], "doc_id long, quality int, extra int")
    model = attention.learned(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in attention.scored(docs, model).collect()}
    assert sum((scores[i] >= 0.5) == (i % 2 == 0) for i in range(160, 240)) >= 76
    every = attention.scored(documents, model).collect()
    assert len(every) == documents.count() and all(0 <= r["score"] <= 1 for r in every)
    assert attention.scored(empty, model).count() == 0
    assert attention.learned(docs, labels.limit(0)) is None and attention.scored(docs, None).first()["score"] == 0.5


def test_passages_cover_whole_texts():
    x, rows = attention.encoded(pa.array(["a " * 300, None, "", "b"]))
    assert list(np.diff(rows)) == [3, 1, 1, 1] and abs(x[:, :128].sum(axis=1)[[0, 1, 2, 5]] - 1).max() < 1e-5


def test_repeats_do_not_depend_on_partitions(spark, documents):
    """What a task sends is the same whenever and wherever it runs, so a lost executor changes nothing."""
    chunks = stored(_chunks.chunked(documents), "test-chunks")
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            cut = repeats._cut(documents, chunks.repartition(int(parts), "chunk"), 20, False, True)
            out.append(sorted(map(str, cut.select("doc_id", "text", "n_words", "n_removed", "removed").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] and any("n_removed=0" not in r for r in out[0])


def test_chained_buckets_are_compared_each_by_itself(spark, monkeypatch):
    """Sets in a long chain, each of which is like the next by half and like no other, meet their own buckets only."""
    seen = []
    real = neardup._met_in_blocks

    def watched(vertices, sets, percent):
        rows = vertices.groupBy("family", "asks", "answers").count().collect()
        seen.append(sum(a["count"] * b["count"] for a in rows for b in rows if a["family"] == b["family"] and a["asks"] and b["answers"]))
        return real(vertices, sets, percent)

    monkeypatch.setattr(neardup, "_met_in_blocks", watched)
    n, half = 600, 12
    rows = [(i, " ".join(f"w{i + k}x{j}" for k in range(2) for j in range(half))) for i in range(n)]
    rows += [(n + i, rows[i][1] + " tail") for i in range(0, n, 50)]
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1, percent=80).collect()}
    assert all(got[i] == i for i in range(n)) and all(got[n + i] == i for i in range(0, n, 50))
    assert sum(seen) < 60 * n  # compared pairs grow with the members of buckets, not with the square of the chain

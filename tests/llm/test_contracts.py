"""Each opN query on a written fixture table, against brute force of what its contract fixes."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_native import _measure, _targets
from test_sets import LOWER, brute_groups, brute_repeats, shingles
from tokenizers import Tokenizer

from tracequarry.llm import fingerprints, mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    documents.write.parquet(f"{at}/documents.parquet")
    turns = [(1, 0, "user", "a [x] <b> \\"), (1, 1, "assistant", "</s>\n"), (1, 2, "assistant", None), (2, 3, "user", "late"), (2, 1, None, "early"), (3, 0, "assistant", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    labels = documents.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct()
    labels.write.parquet(f"{at}/labels.parquet")
    return at


def test_op1(spark, folder, rows):
    out = queries.op1_sharding(spark, folder).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert all(r["law"] == "bytes" and 0 <= r["shard"] < 40 and r["grown_shard"] is None for r in out)
    places = collections.defaultdict(list)
    for r in out:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_op2(spark, folder, rows):
    part, sets = brute_groups(rows, 4, 80)
    least = {}
    for p, r in zip(part, rows):
        if r[0] is not None:
            least[p] = min(least.get(p, r[0]), r[0])
    want = collections.Counter()
    for p, r, s in zip(part, rows, sets):
        of = least.get(p) if s else r[0]
        want[(r[0], len(s), of, r[0] == of)] += 1
    assert collections.Counter(tuple(r) for r in queries.op2_minhash(spark, folder).collect()) == want


def test_op3(spark, folder, rows):
    out = queries.op3_lattice(spark, folder)
    assert out.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    held = collections.Counter((r[0], zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1, len(WORD.findall(r[1] or "")) + 1) for r in rows)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"]) for r in got) == held
    assert all(r["score"] < 0 and math.isfinite(r["score"]) and r["n_known"] <= r["n_tokens"] for r in got)


def test_op4(spark, folder, rows):
    want = collections.Counter()
    for r in rows:
        m = _measure(r[1])
        want[(r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    out = queries.op4_quality(spark, folder).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == want
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_op5(spark, folder):
    said = "</s>[INST] ok [/INST]"
    want = {1: [("user", "a [x] <b> \\"), ("assistant", "</s>\n"), ("assistant", "")], 2: [("", "early"), ("user", "late")], 3: [("assistant", "")], -1: [("user", said), ("assistant", said)]}
    got = {r["conv_id"]: r for r in queries.op5_chat(spark, folder).collect()}
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        told = "".join(f"{role}\n{t}\n" for role, t in turns)
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] > sum(len(t) for _, t in turns)


def test_op6(spark, folder, rows):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = queries.op6_packing(spark, folder).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [at for at, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024
    assert len(by) <= -(-sum(r["length"] for r in got) // 1024) + 2


def test_op7(spark, folder, rows):
    want = collections.Counter()
    for r, (w, gone) in zip(rows, brute_repeats(rows, 35)):
        left = " ".join(x for x, g in zip(w, gone) if not g)
        want[(r[0], len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in queries.op7_repeats(spark, folder).collect()) == want


def test_op8(spark, folder, rows, tmp_path):
    out = queries.op8_attention(spark, folder).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(r[0] for r in rows)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) + ("" if i % 2 else "!#") for _ in range(rng.randint(20, 300)))) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = [r for r in queries.op8_attention(spark, str(tmp_path)).collect() if r["held_out"]]
    assert len(held) > 60 and sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.95 * len(held)


def test_op9(spark, folder, rows):
    totals = collections.Counter()
    for r in rows:
        totals[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(s for s in totals if s is not None) + [None]
    want = _targets({s: totals[s] for s in order}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    got = queries.op9_mixing(spark, folder).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    assert {round(r["target"], 6) for r in got} == {round(want[s], 6) for s in order} and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken = collections.Counter()
    for r in got:
        taken[round(r["target"], 6)] += r["taken"]
    for s in order:
        assert abs(taken[round(want[s], 6)] - want[s]) <= max(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s)


def test_op10(spark, folder, rows):
    got = queries.op10_fingerprints(spark, folder).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    texts = collections.defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1] or "")
    one = {k: next(iter(v)) for k, v in texts.items() if k is not None and len(v) == 1}
    prints = {r["doc_id"]: r for r in got}
    hashes = {}  # what a fingerprint holds, told by shingles: equal shingles have equal hashes
    order = sorted(one, reverse=True)
    for here, after in zip(order, order[1:]):
        if sum(r[0] == here for r in rows) > 1:
            continue
        r, text, other = prints[here], one[here], one[after]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-12
        assert abs(r["near_next"] - fingerprints.likeness(r["fingerprint"], prints[after]["fingerprint"])) < 1e-12
        n = len(shingles(text, 5))
        kept = fingerprints.read(r["fingerprint"])[1]
        assert (len(kept) == 0) == (n == 0) and len(kept) <= n and abs(len(kept) - n / 8) <= 1 + 5 * math.sqrt(n / 8)
        hashes.setdefault(text.translate(LOWER), r["fingerprint"])
        assert hashes[text.translate(LOWER)] == r["fingerprint"]


def test_clashing_columns_come_through(spark, documents):
    from tracequarry.llm import attention, quality

    clash = documents.select("doc_id", "text", "source", *[F.lit(k).alias(c) for k, c in enumerate(["_words", "_lines", "by_words", "label", "_whole", "_last", "_extra", "whole", "last", "extra", "row", "target", "source_size", "sum", "bucket"])])
    led = quality.ledger(clash)
    assert set(clash.columns) <= set(led.columns) and len(led.columns) == len(set(led.columns))
    assert led.select("_words", "by_words").distinct().collect() == [(0, 2)]
    mix = mixing.with_repetitions(clash, mixing.mix_plan(clash))
    assert sorted(mix.columns) == sorted({*clash.columns, "repetitions"}) and mix.count() == clash.count()
    assert mixing.mixed(clash).columns == clash.columns
    labels = documents.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(1).alias("text"))
    assert attention.learned(clash, labels) is not None

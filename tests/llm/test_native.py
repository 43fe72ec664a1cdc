"""Sharding, quality rules, chat formatting and mixing against brute force on awkward rows."""

import collections
import hashlib
import re
import zlib

from pyspark.sql import functions as F

from tracequarry.llm import chat, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_are_near_equal_and_places_gapless(spark, documents, rows, tmp_path):
    folder = f"file://{tmp_path}/map"
    out = sharding.sharded(documents, shards=5, slots=64, folder=folder).collect()
    assert len(out) == len(rows)
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    load, places, slots = collections.Counter(), collections.defaultdict(list), {}
    for r in out:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        assert slots.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    heaviest = max(collections.Counter({v: sum(r["size"] for r in out if r["virtual_slot"] == v) for v in slots}).values())
    assert max(load.values()) - min(load[s] for s in range(5)) <= heaviest
    assert spark.read.parquet(folder).select("version").distinct().count() == 2


def test_rebalancing_moves_little_when_a_shard_is_added(spark):
    slots = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), F.lit(10).cast("long").alias("bytes"), F.lit(1).cast("long").alias("n_rows"))
    first = sharding.initial_map(spark, 64, 4)
    second = sharding.rebalanced(first, slots, 5, keep=1.0)
    moved = first.join(second, "virtual_slot").where(first["shard"] != second["shard"]).count()
    assert second.count() == 64 and moved <= 64 - 4 * 12
    assert second.select("version").distinct().collect()[0][0] == 1


def test_sharding_empty(empty):
    assert sharding.sharded(empty, shards=3, slots=8).count() == 0


def _measure(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {p + k for p in range(len(w) - 4) if grams[tuple(w[p : p + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_ledger_measures_every_text(documents, rows):
    named = documents.withColumnRenamed("text", "body").drop("n_words")
    out = quality.ledger(named, text="body").select("body", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed").collect()
    assert len(out) == len(rows)
    for r in out:
        got = _measure(r["body"])
        assert tuple(r)[1:6] == got
        assert bool(r["failed"] & 1) == (got[0] < 10) and bool(r["failed"] & 2) == (100 * got[4] > 20 * got[0])


def test_policies_and_ablation(documents, empty):
    led = quality.ledger(documents.drop("n_words")).cache()
    masks = [r["failed"] for r in led.collect()]
    for row in quality.ablation(led, 2).collect():
        bit = quality.mask((row["rule"],))
        assert row["n_failed"] == sum(bool(m & bit) for m in masks)
        assert row["n_failed_alone"] == sum(m == bit for m in masks)
        assert row["n_kept_without"] == sum(m & ~bit == 0 for m in masks)
    assert led.where(quality.kept(1)).count() == sum(m & 3 == 0 for m in masks)
    assert quality.ledger(empty.drop("n_words")).count() == 0 and quality.ablation(quality.ledger(empty.drop("n_words")), 2).count() == 0


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "be <|end|> kind"), (1, 1, "user", "a\\b [INST]"), (1, 2, "assistant", "</s> \\< <\\ |>\n"), (2, 5, "assistant", None), (2, 3, None, "x"), (3, 0, "user", ""), (3, 0, "user", ""), (None, 0, "assistant", "no id")]
    turns += [(9, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.as_trees(df)).withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("loss", chat.loss_texts(F.col("formatted"), F.col("loss_spans"))).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(turns, key=lambda z: (str(z[0]), z[1])):
        want[c].append((r or "", x or ""))
    assert len(out) == len(want)
    for r in out:
        assert [tuple(t) for t in r["turns"]] == want[r["tree"]]
        assert r["loss"] == [x for role, x in want[r["tree"]] if role == "assistant"]
        for s in r["loss_spans"]:
            assert r["formatted"][: s["start"]].endswith("<|sep|>") and r["formatted"][s["end"] :].startswith("<|end|>")


def test_chat_chooses_the_best_branch(spark):
    #      1 - 2 - 3 (leaf), 1 - 4 (leaf), 1 - 2 - 5 - 6 (leaf); 7 replies to nobody known
    nodes = [(1, None, 1.0), (2, 1, 1.0), (3, 2, 0.0), (4, 1, 5.0), (5, 2, 1.0), (6, 5, None), (7, 99, 0.0)]
    df = spark.createDataFrame([("t", n, p, "user", f"m{n}", s) for n, p, s in nodes], "tree string, node long, parent long, role string, text string, score double")
    paths = {(r["leaf"], r["node"]): r["up"] for r in chat.paths(df).collect()}
    assert paths == {(3, 3): 0, (3, 2): 1, (3, 1): 2, (4, 4): 0, (4, 1): 1, (6, 6): 0, (6, 5): 1, (6, 2): 2, (6, 1): 3, (7, 7): 0}
    best = chat.formatted(df).collect()
    assert [(r["leaf"], r["branch_score"]) for r in best] == [(4, 3.0)]
    every = chat.formatted(df, best=None)
    assert [r["leaf"] for r in every.orderBy("branch_rank").collect()] == [4, 6, 3, 7]
    assert chat.formatted(df.limit(0)).count() == 0


def _targets(sizes, weights, share=1.5, epochs=2.0):
    left, total, out = set(sizes), share * sum(sizes.values()), {}
    while left:
        w = sum(weights[s] for s in left)
        over = {s for s in left if total * weights[s] / w > epochs * sizes[s] + 1e-9}
        for s in over or left:
            out[s] = epochs * sizes[s] if over else total * weights[s] / w
        if not over:
            break
        total -= sum(out[s] for s in over)
        left -= over
    return out


def test_mix_meets_targets(documents, rows):
    sized = [(r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows]
    totals = collections.Counter()
    for _, s, n in sized:
        totals[s] += n
    order = sorted((s for s in totals if s is not None)) + [None]
    want = _targets({s: totals[s] for s in order}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    plan = mixing.mix_plan(documents)
    got = mixing.with_repetitions(documents, plan).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == totals[r["source"]] and 0 <= r["repetitions"] <= 2
        taken[r["source"]] += r["repetitions"] * len(WORD.findall(r["text"] or ""))
    for s in order:
        assert abs(taken[s] - want[s]) <= max((n for _, t, n in sized if t == s), default=0)
    whole = mixing.mixed(documents)
    assert whole.columns == documents.columns and whole.count() == sum(r["repetitions"] for r in got)
    again = mixing.mixed(documents)
    digest = lambda df: sorted(hashlib.md5(repr(tuple(r)).encode()).hexdigest() for r in df.collect())
    assert digest(whole) == digest(again)


def test_mix_empty(empty):
    assert mixing.mixed(empty).count() == 0

"""Each stage of the pipeline against brute force on what its predecessor kept, and the whole run."""

import collections
import re

import corpus_pipeline
import pytest
from test_sets import brute_groups, brute_repeats

from tracequarry.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def kept(spark, documents, tmp_path_factory):
    """What each stage returns, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    out = [documents]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "unused").write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_order_and_columns(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "mixing", "packing"]
    assert all(df.columns == kept[0].columns for df in kept[1:-1])


def test_quality_stage(kept, documents):
    led = quality.ledger(documents.select("doc_id", "text"))
    want = collections.Counter((r["doc_id"], r["text"]) for r in led.where("failed = 0").collect())
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept[1].collect()) == want


def test_near_duplicate_stage(kept):
    rows = [(r["doc_id"], r["text"]) for r in kept[1].collect()]
    part, sets = brute_groups(rows, 5, 80)
    assert kept[2].count() == len({p for p, s in zip(part, sets) if s}) + sum(not s for s in sets)


def test_passage_stage(kept):
    rows = [(r["doc_id"], r["text"]) for r in kept[2].collect()]
    want = collections.Counter((r[0], tuple(x for x, g in zip(w, gone) if not g)) for r, (w, gone) in zip(rows, brute_repeats(rows, 50)))
    got = kept[3].collect()
    assert collections.Counter((r["doc_id"], tuple(WORD.findall(r["text"]))) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_mix_stage_repeats_at_most_twice(kept):
    before = collections.Counter((r["doc_id"], r["text"]) for r in kept[3].collect())
    after = collections.Counter((r["doc_id"], r["text"]) for r in kept[4].collect())
    assert all(n <= 2 * before[k] for k, n in after.items())
    words = lambda c: sum(n * len(WORD.findall(t)) for (_, t), n in c.items())
    assert words(after) > words(before)


def test_packing_stage(kept):
    rows = kept[5].collect()
    load = collections.Counter()
    for r in rows:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 1024 and sum(r["piece"] == 0 for r in rows) == kept[4].count()


def _tables(spark):
    at = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    return {f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)}


def test_run_leaves_its_result_alone(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    before = _tables(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(_tables(spark) - before) == 1
    rows = out.collect()
    assert rows and len({(r["row"], r["piece"]) for r in rows}) == len(rows)


def test_stages_of_an_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "unused")
        assert docs.columns == empty.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "unused").count() == 0

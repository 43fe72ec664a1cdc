"""A pipeline from raw documents to packed training sequences; part of the subpackage tracequarry.llm.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as Parquet and read again for the next; all but
the last return the columns of documents, whatever these are besides doc_id, text and source, in their order and types. An empty
table gives an empty result of the same columns. Nulls pass through in every column that a stage does not decide on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import mixing, neardup, packing, quality, repeats
from tracequarry.llm._store import scratch, stored

CAPACITY = 1024


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass version 2 of the quality policy. A null or empty text has too few words and goes; repeated rows are judged alike."""
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return quality.ledger(whole).where(quality.kept(2)).select("_row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): that of the least doc_id, nulls last; of rows with
    one doc_id any one. Repeated rows are one group. Documents without words all stay."""
    return neardup.deduplicated(docs, shingle=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less every passage of 50 words or more that stands elsewhere too, at all its places; n_chars follows the text. No row goes; a
    null text comes back empty."""
    cut = repeats.without_repeats(docs, window=50, results=False)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 150 % of the words, weights 5, 2, 1, twice at most. A null source is a source
    of its own; documents of one source with one doc_id are drawn together; those without words come with the whole repetitions."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens. A document that the mix repeats is several rows, told apart by
    `row`; a null or empty text is its end alone."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), capacity=CAPACITY, end=2)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", keep_one_of_each_group),
    ("repeated passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Sketches and automata are not SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents. What stages leave in the shared folder is deleted, but for the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for k, (_, stage) in enumerate(STAGES):
            with scratch(spark):
                docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}", keep=True)
        return stored(docs, "pipeline", keep=True)

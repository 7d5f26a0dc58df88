"""A training corpus from raw documents: toxic documents go, then exact and near copies; sources are mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bramble.llm import best_fit, exact_dedup, jaccard_join, mixing, toxicity
from bramble.llm.common import new_path, read
from bramble.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8."""
    return jaccard_join.keep_one(docs, k=5, numerator=80, denominator=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: a row for each pass that takes some of a document."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 4096 tokens."""
    return best_fit.pack_documents(docs, tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: No SQL: the toxicity scores and the packing are not expressible in it; tests/llm holds brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for n, (_, step) in enumerate(STAGES):
        path = new_path(spark, f"stage{n}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

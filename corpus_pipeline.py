"""A training-corpus pipeline over ``documents``: quality rules, near-duplicates, personal
data, source mixing, packing.

Each stage takes all that its predecessor kept and returns the columns of ``documents``; the
last one returns the packed pieces. ``run`` writes every stage's result as Parquet below the
shared checkpoint folder and reads it back for the next, so a lost executor costs a stage's
lost tasks and no stage runs twice.

Defined results, stage by stage: a null or empty text is rejected by the quality rules; rows
without an id are linked with nothing and stay, rows that repeat one are one document;
masking keeps every row and a null text null; null sources and languages are cells of their
own in the mixture; a text without tokens packs as its end id. Further columns pass through,
whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, dedup, mixing, packing, pii, quality
from quarry.session import scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its personal data masked."""
    return pii.mask_pii(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target marginals of source, language and topic."""
    return mixing.sample_mixture(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. Executors serve other stages
    before and after, so their workers give the tokenizer's memory back with each task."""
    return packing.pack_documents(docs, keep_words=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizing and packing are not expressible in SQL: tests/llm holds the stages against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table of documents."""
    docs = common.table(spark, sf_dir, "documents")
    base = scratch_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs

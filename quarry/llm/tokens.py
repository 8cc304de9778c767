"""Token counts of whole texts by heap-and-linked-list byte-pair merging.

Defined results: a null or empty text has 0 bytes and 0 tokens and is under any limit;
repeated rows and null ids are counted row by row; an empty table gives an empty result;
only the named text column is read. Texts of any length are counted whole: memory is the
text and a bounded memory of pretokens.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, common

LIMIT = 2048


@cache
def _counter(path: str | None) -> bpe.WordCounter:
    """One counter per worker process."""
    return bpe.WordCounter(path)


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of tokens of a text column under a tokenizer file (default: the public
    word-level file); ``path`` must exist on every executor."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        counts = pa.array(_counter(path).counts(t.as_py() for t in texts), pa.int64())
        common.give_back()
        return counts

    return count(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens, over_limit."""
    common.bounded_batches(docs.sparkSession)
    text = common.col(text_col)
    counted = docs.select(
        common.col(id_col).alias(id_col),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(text, path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(common.table(spark, sf_dir, "documents"))

"""What the operators share: reading tables, free column names, checkpoints, text helpers."""

from __future__ import annotations

import ctypes
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

#: The words of a text are the runs of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def bounded_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Arrow batches of texts of some 8 MB instead of 64 MB, unless the session has a bound of
    its own: every running task holds a batch on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(limit))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


_calls = count(1)


def give_back(every: int = 8) -> None:
    """Hand memory that freed buffers still hold back to the system, at every so many calls.
    A worker serves many batches; without this, each of its allocators keeps its own peak."""
    if next(_calls) % every:
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)

"""A file stream of delimited lines with the batch reader's shape and NA rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import normalize_names
from quarry.functions.parse import null_tokens
from quarry.sources.delimited import _split_header, decoded, field_count, line_reader, text_fields, without_cr


def stream_delimited(spark: SparkSession, folder: str, header: str, sep: str = ",",
                     strict: bool = False, encoding: str = "auto", max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of all-text rows from files landing in ``folder``.

    The first non-blank line of each file is its header and goes by position; blank lines are
    skipped; lines with more fields than the header or an unclosed quote are dropped
    (``strict`` also drops shorter ones); bytes are decoded as in the batch reader. Typing
    needs whole-column evidence, so it is applied per micro-batch by the caller
    (``foreachBatch``) or with types decided from a first file.
    """
    names = _split_header(header, sep)
    clean, _ = normalize_names(names)
    width = len(names)
    reader = line_reader(spark.readStream, header=True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.csv(folder).select(without_cr(decoded(F.col("value"), encoding)).alias("value"))
    n = field_count(F.col("value"), sep)
    ok = F.coalesce((n == width) if strict else (n <= width), F.lit(False))
    parsed = lines.where((F.length(F.trim("value")) > 0) & ok).select(
        F.from_csv("value", text_fields(width), {"sep": sep, "quote": '"', "escape": '"'}).alias("r"))
    return parsed.select(*[null_tokens(F.col(f"r._c{i}")).alias(clean[i]) for i in range(width)])

"""Not-a-number as missing: every entry point turns NaN into NULL once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def without_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` with NaN replaced by NULL in its floating-point columns (or the named ones)."""
    wanted = set(df.columns if columns is None else columns)
    floating = [f.name for f in df.schema.fields if f.name in wanted and isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floating}) if floating else df

"""KPI value formatting: B / M / K with one decimal, else a grouped integer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_kpi_value(col) -> Column:
    """Column form. ``format_number`` rounds half-even on the binary value, as Python does."""
    v = F.col(col) if isinstance(col, str) else col
    a = F.abs(v)

    def scaled(div: float, suffix: str) -> Column:
        return F.concat(F.regexp_replace(F.format_number(v / F.lit(div), 1), ",", ""), F.lit(suffix))

    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(a >= 1_000_000_000, scaled(1_000_000_000.0, "B"))
        .when(a >= 1_000_000, scaled(1_000_000.0, "M"))
        .when(a >= 1_000, scaled(1_000.0, "K"))
        .otherwise(F.format_number(v, 0))
    )


"""Running and moving functions over rows in an explicit order (A11), without one task for all.

The rows are range-partitioned by the order, sorted within partitions and numbered (a
partition's rows begin at the number of rows before it). Numbers cut them into blocks of
``BLOCK`` rows, and a row near the end of its block also goes, as context, to the next block, so
a window within a block sees what it needs from the one before. Running totals add what the
blocks before hold, from a table with a row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

#: Rows of a block; a window function holds one block in a task.
BLOCK = 1 << 20
_INDEX_BITS = 33  # of monotonically_increasing_id: the place within a partition


def numbered(df: DataFrame, order_by: list[str], value: Column, mask: Column | None = None) -> DataFrame:
    """``(place, v)``: the values with their places from 0 in the order of the columns, ties by
    value. Saved in the checkpoint folder, as places must not change."""
    src = df if mask is None else df.where(mask)
    keys = [F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order_by)]
    order = [f"__o{i}" for i in range(len(keys))] + ["v"]
    rows = src.select(*keys, value.cast("double").alias("v"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("v", F.monotonically_increasing_id().alias("id"))
    ensure_checkpoint_dir(df.sparkSession)
    held = sorted_rows.checkpoint(eager=True).withColumn("part", F.shiftright("id", _INDEX_BITS))
    counts = held.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row per partition
    place = F.col("offset") + F.col("id").bitwiseAND((1 << _INDEX_BITS) - 1)
    return held.join(F.broadcast(offsets), "part").select(place.alias("place"), "v")


def _blocks(rows: DataFrame, back: int = 0) -> DataFrame:
    """Rows with their block; the last ``back`` rows before a block are in it too, not own."""
    size = max(BLOCK, back)
    block = F.floor(F.col("place") / size)
    if not back:
        return rows.select("*", block.alias("block"), F.lit(True).alias("own"))
    copies = F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.when(F.col("place") % size >= size - back, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))))
    return rows.select("*", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("c")).select("place", "v", "c.*")


def _moving(rows: DataFrame, fn: str, n: int) -> DataFrame:
    w = Window.partitionBy("block").orderBy("place")
    earlier = F.lag("v", n).over(w)
    if fn.startswith("rolling_"):
        span = w.rowsBetween(-(n - 1), Window.currentRow)
        agg = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[fn.removeprefix("rolling_")]
        out, back = F.when(F.count("v").over(span) == n, agg("v").over(span)), n - 1
    else:
        out, back = {"diff": F.col("v") - earlier, "shift": earlier, "pct_change": F.try_divide(F.col("v"), earlier) - 1}[fn], n
    return _blocks(rows, back).select(out.alias("r"), "own").where("own").select("r")


def _cumulated(rows: DataFrame, fn: str) -> DataFrame:
    agg = {"cumsum": F.sum, "cummax": F.max, "cummin": F.min}[fn]
    both = {"cumsum": lambda a, b: a + b, "cummax": F.greatest, "cummin": F.least}[fn]
    held = _blocks(rows)
    totals = held.groupBy("block").agg(agg("v").alias("t"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("block", agg("t").over(earlier).alias("before"))  # a row per block
    upto = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = held.select("block", "v", agg("v").over(upto).alias("own"))
    value = F.when(F.col("before").isNull(), F.col("own")).otherwise(both(F.col("own"), F.col("before")))
    return own.join(F.broadcast(before), "block").select(F.when(F.col("v").isNotNull(), value).alias("r"))


def running(df: DataFrame, order_by: list[str], value: Column, fn: str, n: int = 1, mask: Column | None = None) -> DataFrame:
    """``r``: ``cumsum``, ``cummax``, ``cummin``, ``diff``, ``shift``, ``pct_change`` or
    ``rolling_mean`` / ``_sum`` / ``_min`` / ``_max`` of ``n`` rows, as pandas gives them for
    rows in that order: missing where a value or a full window is missing."""
    rows = numbered(df, order_by, value, mask)
    return _cumulated(rows, fn) if fn.startswith("cum") else _moving(rows, fn, n)

"""The aggregate tables behind each chart kind.

Every function takes the (already filtered) DataFrame and returns a lazy DataFrame with
the chart's data. Groupings are single-key hash aggregations with map-side partial
aggregation, so a hot key collapses before the shuffle. Top-k outputs end in
``orderBy(...).limit(k)``, which Spark plans as ``TakeOrderedAndProject`` (a bounded
per-partition heap, no global sort). Ties are broken by the key, ascending.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.missing import without_nan
from quarry.functions.dates import date_column

HIST_BINS = 20


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def total(df: DataFrame, y: str) -> Column:
    """``sum(y)``, 0 for no value; whole numbers add up as decimals, so no total overflows."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    v = _q(y).cast("decimal(19,0)") if isinstance(df.schema[y].dataType, whole) else _q(y)
    return F.coalesce(F.sum(v), F.lit(0))


def _as_time(df: DataFrame, x: str) -> Column:
    """A datetime view of ``x``: typed columns as they are, text parsed leniently."""
    dt = df.schema[x].dataType
    if isinstance(dt, T.StringType):
        return date_column(df, x)
    return _q(x)


_DATE_GRAINS = {"day": None, "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def truncate_time(t: Column, grain: str) -> Column:
    """Wall-clock truncation of a datetime. Day and coarser grains go through ``to_date`` /
    ``trunc``, which involve no time zone; finer grains use ``date_trunc``."""
    g = grain.lower()
    if g in _DATE_GRAINS:
        d = F.to_date(t)
        if _DATE_GRAINS[g]:
            d = F.trunc(d, _DATE_GRAINS[g])
        return d.cast("timestamp_ntz")
    return F.date_trunc(g, t).cast("timestamp_ntz")


def value_frequencies(df: DataFrame, x: str, k: int | None = None, ordered: bool = True) -> DataFrame:
    """Count per non-null value, most frequent first, ties by value.

    With ``k`` the order is what picks the rows (a bounded top-k); without it,
    ``ordered=False`` leaves out the global sort when the caller does not need it."""
    out = (
        df.where(_q(x).isNotNull())
        .groupBy(_q(x).alias("x"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if k is not None:
        return out.orderBy(F.desc("count"), F.asc("x")).limit(k)
    return out.orderBy(F.desc("count"), F.asc("x")) if ordered else out


def time_series(df: DataFrame, x: str, y: str, grain: str | None = None, ordered: bool = True) -> DataFrame:
    """sum(y) per x, NULL x dropped, ordered by x; text x is parsed first.

    ``grain`` (``day``, ``week``, ``month``, ...) truncates x before grouping, which keeps the
    output small when x is a raw event time.
    """
    df = without_nan(df, [y])
    t = _as_time(df, x)
    if grain:
        t = truncate_time(t, grain)
    out = (
        df.where(t.isNotNull())
        .groupBy(t.alias("x"))
        .agg(total(df, y).alias("y"))
    )
    return out.orderBy("x") if ordered else out


def bar(df: DataFrame, x: str, y: str | None = None, k: int = 10) -> DataFrame:
    """Top-k of count per x (no y) or of sum(y) per x. Ties keep the smaller key."""
    df = without_nan(df, [c for c in (x, y) if c])
    if not y:
        return value_frequencies(df, x, k).withColumnRenamed("count", "y")
    return (
        df.where(_q(x).isNotNull())
        .groupBy(_q(x).alias("x"))
        .agg(total(df, y).alias("y"))
        .orderBy(F.desc("y"), F.asc("x"))
        .limit(k)
    )


def _bounds(df: DataFrame, x: str) -> tuple[float | None, float | None]:
    r = df.agg(F.min(_q(x)).cast("double").alias("lo"), F.max(_q(x)).cast("double").alias("hi")).first()
    return r["lo"], r["hi"]


def histogram(df: DataFrame, x: str, bins: int = HIST_BINS, keep_empty: bool = False,
              ordered: bool = True) -> DataFrame:
    """``bins`` equal-width bins over [min, max], the last bin closed.

    One bin when min = max. Numeric x gives ``(bin, bin_lo, bin_hi, count)``; text x is
    counted per value (``x``, ``count``). The two bounds are one small aggregate; the bins
    are then a plain projection and a partial-aggregated group-by of at most ``bins`` keys.
    """
    df = without_nan(df, [x])
    dt = df.schema[x].dataType
    if not isinstance(dt, T.NumericType):
        counts = value_frequencies(df, x, ordered=False)
        return counts.orderBy("x") if ordered else counts
    lo, hi = _bounds(df, x)
    schema = "bin int, bin_lo double, bin_hi double, count bigint"
    if lo is None:
        return df.sparkSession.createDataFrame([], schema)
    v = _q(x).cast("double")
    if hi == lo:
        b = F.lit(0)
        lo_e = F.lit(lo)
        hi_e = F.lit(hi)
    else:
        w = (F.lit(hi) - F.lit(lo)) / F.lit(float(bins))
        b = F.least(F.floor((v - F.lit(lo)) / w), F.lit(bins - 1)).cast("int")
        lo_e = F.lit(lo) + F.col("bin") * w
        hi_e = F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * w)
    out = (
        df.where(_q(x).isNotNull())
        .select(b.alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("bin", lo_e.alias("bin_lo"), hi_e.alias("bin_hi"), "count")
    )
    if keep_empty and hi != lo:
        spark = df.sparkSession
        w = (hi - lo) / bins
        allbins = spark.createDataFrame(
            [(i, lo + i * w, hi if i == bins - 1 else lo + (i + 1) * w) for i in range(bins)],
            "bin int, bin_lo double, bin_hi double",
        )
        out = allbins.join(out.select("bin", "count"), "bin", "left").select(
            "bin", "bin_lo", "bin_hi", F.coalesce("count", F.lit(0)).alias("count"))
    return out.orderBy("bin") if ordered else out


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every (x, y) row of the filtered table."""
    df = without_nan(df, [x, y])
    return df.select(_q(x).alias("x"), _q(y).alias("y"))


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order; booleans are not numeric here."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


class _Moments:
    """Pairwise-complete counts, means and centred products of columns, of one or more batches.

    ``mean[i, j]`` and ``square[i, j]`` are those of column i over the rows where j is present
    too. Batches are centred before they are multiplied and merged by their means, so a large
    mean costs no digits.
    """

    def __init__(self, x: np.ndarray):
        there = ~np.isnan(x)
        centre = np.where(there.any(axis=0), np.nanmean(np.where(there, x, np.nan), axis=0) if len(x) else 0.0, 0.0)
        x, m = np.where(there, x - centre, 0.0), there.astype(float)
        self.n = m.T @ m
        n = np.maximum(self.n, 1)
        off = (x.T @ m) / n
        self.square = np.maximum((x * x).T @ m - n * off * off, 0)
        self.cross = x.T @ x - n * off * off.T
        self.mean = off + centre[:, None]

    def merge(self, other: _Moments) -> None:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        apart, weight = other.mean - self.mean, self.n * share
        self.square += other.square + apart * apart * weight
        self.cross += other.cross + apart * apart.T * weight
        self.mean += apart * share
        self.n = n


def _pair_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per pair of columns and task: i, j, n, mx, my, cxx, cyy, cxy."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = _Moments(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
        if total is None:
            total = part
        else:
            total.merge(part)
    if total is not None:
        i, j = np.triu_indices(len(total.n))
        cells = (i, j, total.n[i, j], total.mean[i, j], total.mean[j, i], total.square[i, j], total.square[j, i], total.cross[i, j])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["i", "j", "n", "mx", "my", "cxx", "cyy", "cxy"])


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The full correlation matrix in long form ``(col_x, col_y, corr)``.

    Pairwise-complete Pearson, NULL when undefined, diagonal 1.0 unless the column is
    constant or empty; fewer than two numeric columns, or no rows, gives an empty table.

    One scan, whatever the number of columns: each task multiplies its Arrow batches as
    matrices and gives one row per pair; these are merged by their means.
    """
    df = without_nan(df)
    cols = columns if columns is not None else numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_x string, col_y string, corr double")
    numbers = df.select(*(_q(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)))
    parts = numbers.mapInArrow(_pair_moments, "i long, j long, n double, mx double, my double, cxx double, cyy double, cxy double")
    pair = Window.partitionBy("i", "j")
    away = lambda m: F.col(m) - F.sum(F.col("n") * F.col(m)).over(pair) / F.nullif(F.sum("n").over(pair), F.lit(0.0))
    spread = parts.select("i", "j", "n", "cxx", "cyy", "cxy", F.coalesce(away("mx"), F.lit(0.0)).alias("dx"), F.coalesce(away("my"), F.lit(0.0)).alias("dy"))
    sums = spread.groupBy("i", "j").agg(
        F.sum(F.col("cxx") + F.col("n") * F.col("dx") * F.col("dx")).alias("xx"),
        F.sum(F.col("cyy") + F.col("n") * F.col("dy") * F.col("dy")).alias("yy"),
        F.sum(F.col("cxy") + F.col("n") * F.col("dx") * F.col("dy")).alias("xy"),
    )
    names = F.array(*(F.lit(c) for c in cols))
    name = lambda k: F.get(names, F.col(k).cast("int"))
    corr = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct(name("i").alias("col_x"), name("j").alias("col_y"), F.when(F.col("xx") > 0, F.lit(1.0)).alias("corr")))).otherwise(
        F.array(*(F.struct(name(a).alias("col_x"), name(b).alias("col_y"), corr.alias("corr")) for a, b in (("i", "j"), ("j", "i"))))
    )
    return sums.select(F.inline(both))


def pie(df: DataFrame, x: str, y: str | None = None, k: int = 8, by: str = "key") -> DataFrame:
    """Slices ``(x, y, share)``.

    Without y: the k most frequent values. With y: sum(y) per x, and the first k *by key*
    (``by='key'``, as the reference does) or the k largest (``by='largest'``). ``share`` is
    the slice's part of the k slices shown.
    """
    df = without_nan(df, [c for c in (x, y) if c])
    if not y:
        base = value_frequencies(df, x, k).withColumnRenamed("count", "y")
    else:
        g = (
            df.where(_q(x).isNotNull())
            .groupBy(_q(x).alias("x"))
            .agg(total(df, y).alias("y"))
        )
        order = [F.asc("x")] if by == "key" else [F.desc("y"), F.asc("x")]
        base = g.orderBy(*order).limit(k)
    # At most k rows here, so one window over all of them is cheap and bounded.
    whole = F.sum("y").over(Window.partitionBy(F.lit(0)))
    return base.select("x", "y", F.try_divide(F.col("y").cast("double"), whole.cast("double")).alias("share"))


def funnel(df: DataFrame, x: str, y: str, ordered: bool = True) -> DataFrame:
    """sum(y) per x, largest first, no limit."""
    df = without_nan(df, [x, y])
    out = (
        df.where(_q(x).isNotNull())
        .groupBy(_q(x).alias("x"))
        .agg(total(df, y).alias("y"))
    )
    return out.orderBy(F.desc("y"), F.asc("x")) if ordered else out


def preview(df: DataFrame, order_by: list[str] | None = None, n: int = 5) -> DataFrame:
    """The first n rows by an explicit order (the first column by default)."""
    keys = order_by or [df.columns[0]]
    return df.orderBy(*[_q(k) for k in keys]).limit(n)


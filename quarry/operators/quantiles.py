"""Exact quantiles with linear interpolation, without holding a column in one task.

pandas ``Series.quantile(p)`` is the value at position ``h = (n - 1) * p`` of the sorted
non-missing values, interpolated between the neighbours ``floor(h)`` and ``floor(h) + 1``.
Spark's exact ``percentile`` keeps a map of every distinct value in a single task, which
does not survive a 100 TB column, and ``percentile_approx`` is not exact. So the order
statistics of all wanted ranks are found together, by selection:

* one scan takes the count, the extremes and a coarse grid of approximate quantiles;
* each further scan cuts the ranges that still hold a wanted rank at their grids, counts
  every part exactly (with its extremes and a grid of its own) and keeps the parts that hold
  a rank. Grids follow the values, so a long tail costs no extra scans, and each grid value
  is a part of its own, so a value that fills most of a range settles at once;
* what is left of at most ``GATHER`` rows a range is counted by value in one last job.

Ranges are pushed down as filters. Only counts, grids and the last few values reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

GRID = 32
GATHER = 20_000


@dataclass
class _Range:
    """The values in ``[lo, hi]``: ``count`` of them, ``below`` smaller ones outside."""

    lo: float
    hi: float
    below: int
    count: int
    grid: list[float]

    def holds(self, rank: int) -> bool:
        return self.below <= rank < self.below + self.count

    def inside(self) -> Column:
        return F.col("v").between(F.lit(self.lo), F.lit(self.hi))

    def cuts(self) -> list[float]:
        """Grid values and their lower neighbours: each grid value becomes a part."""
        return sorted({c for g in self.grid for c in (math.nextafter(g, -math.inf), g) if self.lo <= c < self.hi})


def _grid() -> Column:
    return F.percentile_approx("v", [(i + 0.5) / GRID for i in range(GRID)], 1000)


def _part(number: int, r: _Range) -> Column:
    """A row's part: the range's number, and how many cuts lie below the value."""
    cuts = r.cuts()
    above = reduce(lambda a, b: a + b, [(F.col("v") > F.lit(c)).cast("int") for c in cuts], F.lit(0))
    return F.when(r.inside(), F.struct(F.lit(number).alias("range"), above.alias("part")))


def _refined(vals: DataFrame, ranges: list[_Range]) -> list[_Range]:
    """The parts of all ranges, counted in one scan."""
    part = F.coalesce(*(_part(i, r) for i, r in enumerate(ranges)))
    rows = (
        vals.where(reduce(or_, (r.inside() for r in ranges))).groupBy(part.alias("p"))
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), _grid().alias("grid")).collect()
    )
    out, below = [], [r.below for r in ranges]
    for row in sorted(rows, key=lambda x: tuple(x["p"])):
        i = row["p"]["range"]
        out.append(_Range(row["lo"], row["hi"], below[i], row["n"], row["grid"]))
        below[i] += row["n"]
    return out


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """pandas-equal quantiles (linear interpolation) of a numeric column; NULL and NaN ignored."""
    v = F.col(f"`{column}`").cast("double")
    vals = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    st = vals.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), _grid().alias("grid")).first()
    n = st["n"]
    if not n:
        return [None for _ in probs]
    places = [((n - 1) * p, math.floor((n - 1) * p)) for p in probs]
    open_ranks = {min(k + d, n - 1) for _, k in places for d in (0, 1)}
    got: dict[int, float] = {}
    ranges = [_Range(st["lo"], st["hi"], 0, n, st["grid"])]
    while open_ranks:
        settled = {k: r.lo for r in ranges for k in open_ranks if r.holds(k) and r.lo == r.hi}
        got |= settled
        open_ranks -= settled.keys()
        ranges = [r for r in ranges if any(map(r.holds, open_ranks))]
        if not ranges:
            break
        if all(r.count <= GATHER for r in ranges):
            rows = vals.where(reduce(or_, (r.inside() for r in ranges))).groupBy("v").agg(F.count("*").alias("n")).collect()
            for r in ranges:
                at = r.below
                for row in sorted(x for x in rows if r.lo <= x["v"] <= r.hi):
                    got |= {k: row["v"] for k in open_ranks if at <= k < at + row["n"]}
                    at += row["n"]
            break
        ranges = _refined(vals, ranges)
    out = []
    for h, k in places:
        a, b = got[k], got[min(k + 1, n - 1)]
        out.append(a if a == b or h == k else a + (b - a) * (h - k))
    return out


def grouped_exact_median(df: DataFrame, key: str, value, partitions: int | None = None) -> DataFrame:
    """``(key, median)`` per group, exact as pandas computes it (the middle value, or the
    mean of the two middle values), without holding any group in one task.

    1. count per ``(key, value)`` (partial aggregation collapses repeats);
    2. range-partition that table by ``(key, value)``, so a group holding a third of the rows
       is spread over many partitions, tag each row with its partition, and checkpoint it;
    3. running counts inside each ``(partition, key)`` slice, plus the slice totals of the
       earlier partitions of the same key (a small table: one row per slice);
    4. the rows whose count interval holds the middle rank(s) give the median.
    NULL keys and values are dropped.
    """
    spark = df.sparkSession
    v = (F.col(f"`{value}`") if isinstance(value, str) else value).cast("double")
    base = df.select(F.col(f"`{key}`").alias("k"), v.alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull())
    freq = base.groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt"))
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = freq.repartitionByRange(n_parts, "k", "v").withColumn("pid", F.spark_partition_id())
    # Both branches below must see the same partition tags: materialize them once in the
    # shared checkpoint folder (this also cuts the lineage before the two passes).
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    upto = Window.partitionBy("pid", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("lcum", F.sum("cnt").over(upto))
    slices = ranged.groupBy("pid", "k").agg(F.sum("cnt").alias("stot"))
    before = Window.partitionBy("k").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        "pid", "k",
        F.coalesce(F.sum("stot").over(before), F.lit(0)).alias("off"),
        F.sum("stot").over(Window.partitionBy("k")).alias("n"),
    )
    g = local.join(offsets, ["pid", "k"]).select(
        "k", "v", (F.col("lcum") + F.col("off")).alias("cum"), "cnt", "n")
    lo = F.floor((F.col("n") - 1) / 2)
    hi = F.ceil((F.col("n") - 1) / 2)
    prev = F.col("cum") - F.col("cnt")
    hit = g.where(((prev <= lo) & (lo < F.col("cum"))) | ((prev <= hi) & (hi < F.col("cum"))))
    return hit.groupBy(F.col("k").alias(key)).agg(((F.min("v") + F.max("v")) / 2).alias("median"))

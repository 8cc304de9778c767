"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Edge tables up to so many rows have their minima broadcast (some 10 MB); larger ones join
#: by shuffle. Either way gives the same rows.
BROADCAST_EDGES = 300_000
#: Edges of a checkpoint partition.
PART_EDGES = 100_000


def _stamp(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its least node.

    Each round replaces the edges by ones to smaller nodes: minima are pre-aggregated per
    node and joined back, so a node with very many neighbours is a skewed join that the
    session splits, never a collected list. The edge set is written to the checkpoint folder
    after each round and does not grow; rounds are logarithmic in the size of a component.
    Null ends and loops are no edges; repeated edges count once; no edge, no row.
    """
    kept = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    now = common.saved(kept.select(F.greatest("x", "y").alias("big"), F.least("x", "y").alias("small")).distinct())
    before, after = None, _stamp(now)
    while after[0] and before != after:
        small = after[0] <= BROADCAST_EDGES
        parts = -(-after[0] // PART_EDGES)
        now = common.saved(_small_star(_large_star(now, small), small).coalesce(parts))
        before, after = after, _stamp(now)
    return now.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(
        now.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    )


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Every larger neighbour of a node goes to the least of the node and its neighbours."""
    least = edges.groupBy(F.col("big").alias("small")).agg(F.min("small").alias("low"))
    return edges.join(F.broadcast(least) if small else least, "small", "left").select("big", F.coalesce("low", "small").alias("small"))


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """A node and its smaller neighbours go to the least of these."""
    least = edges.groupBy("big").agg(F.min("small").alias("low"))
    joined = edges.join(F.broadcast(least) if small else least, "big")
    ends = F.array(F.struct("big", "low"), F.struct(F.col("small").alias("big"), "low"))
    return joined.select(F.inline(ends)).filter("big <> low").select("big", F.col("low").alias("small")).distinct()

"""Nearest neighbours by inner product: vantage-point trees per shard.

The largest inner product is the least distance once every vector gets one more coordinate
that lifts it to the shard's greatest norm and the query gets a zero there, so the triangle
inequality holds and a tree can prune. A subtree is left out for a query when ``factor`` times
its least possible distance exceeds the query's k-th best so far; factor 1 is exact search,
larger factors prune more.

Vectors are dealt by hash into shards of bounded size; each shard's tree is built once, as
one row, and saved. Queries form blocks of bounded size; every block meets every tree in a
task of its own, all queries of a block walk the tree together, and the k best per shard are
merged by a window that first limits within each task. Scores are double-precision inner
products of the original vectors, summed in the same order for every pair.

Defined results: null ids and vectors that are null, empty, zero or hold null or non-finite
components take no part; rows that repeat an id count once (the least vector); vectors meet
queries of their own length only; ties go to the smaller id; an empty table gives an empty
result; only the id and vector columns are read.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

SHARD, BLOCK, LEAF = 8192, 4096, 128
K = 20
#: Measured in the README: recall and work at some factors.
FACTOR = 1.0
_SLACK = 1e-9


class Tree:
    """A vantage-point tree over the rows of one shard.

    ``order`` lists the rows so that a node owns the run ``[start, end)``; an inner node has a
    vantage point and, for each child, the least and greatest distance of its rows to it.
    Halves are split by rank, so any number of equal vectors stays balanced.
    """

    FIELDS = ("ids", "vectors", "top", "nodes", "ranges")

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, nodes: np.ndarray, ranges: np.ndarray):
        self.ids, self.vectors, self.top, self.nodes, self.ranges = ids, vectors, float(top), nodes, ranges

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], np.ascontiguousarray(vectors[by_id], np.float64)
        norm2 = np.einsum("ij,ij->i", vectors, vectors)
        top = float(np.sqrt(norm2.max()))
        lifted = np.column_stack((vectors, np.sqrt(np.maximum(top * top - norm2, 0))))
        order = np.arange(len(ids))
        nodes: list[list[int]] = []  # start, end, inside, outside, vantage row
        ranges: list[list[float]] = []
        rng = np.random.default_rng(0)

        def grow(start: int, end: int) -> int:
            me = len(nodes)
            nodes.append([start, end, -1, -1, -1])
            ranges.append([0.0, 0.0, 0.0, 0.0])
            if end - start > leaf:
                rows = order[start:end]
                v = int(rows[rng.integers(len(rows))])
                away = np.sqrt(np.maximum(((lifted[rows] - lifted[v]) ** 2).sum(axis=1), 0))
                half = len(rows) // 2
                cut = np.argpartition(away, half)
                order[start:end], away = rows[cut], away[cut]
                ranges[me] = [away[:half].min(), away[:half].max(), away[half:].min(), away[half:].max()]
                nodes[me][4] = v
                nodes[me][2] = grow(start, start + half)
                nodes[me][3] = grow(start + half, end)
            return me

        grow(0, len(ids))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        table = np.array(nodes, np.int64)
        table[:, 4] = np.where(table[:, 4] >= 0, place[np.maximum(table[:, 4], 0)], -1)
        return cls(ids[order], vectors[order], top, table, np.array(ranges))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: np.asarray(getattr(self, f)) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as f:
            return cls(*(f[n] for n in cls.FIELDS))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K, factor: float = FACTOR) -> Search:
        s = Search(self, query_ids, queries, k, factor)
        s.visit(0, np.arange(len(queries)))
        return s


class Search:
    """The walk of a block of queries through one tree; keeps each query's k best so far."""

    def __init__(self, tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.tree, self.own, self.q, self.k, self.factor = tree, query_ids, np.ascontiguousarray(queries, np.float64), k, factor
        self.norm2 = np.einsum("ij,ij->i", self.q, self.q)
        self.lift2 = self.norm2 + tree.top * tree.top
        self.slack = _SLACK * (np.sqrt(self.norm2) * tree.top + 1e-300)
        self.score = np.full((len(self.q), k), -np.inf)
        self.id = np.full((len(self.q), k), np.iinfo(np.int64).max)
        self.compared = 0

    def _away(self, rows: np.ndarray, row: int) -> np.ndarray:
        """Distances of queries to a lifted row of the tree."""
        return np.sqrt(np.maximum(self.lift2[rows] - 2 * (self.q[rows] @ self.tree.vectors[row]), 0))

    def _alive(self, rows: np.ndarray, away: np.ndarray, low: float, high: float) -> np.ndarray:
        """The queries for which a child may hold a better row."""
        least = np.maximum(np.maximum(away - high, low - away), 0)
        worst = np.sqrt(np.maximum(self.lift2[rows] - 2 * (self.score[rows, -1] - self.slack[rows]), 0))
        return rows[self.factor * least <= worst * (1 + _SLACK)]

    def visit(self, node: int, rows: np.ndarray) -> None:
        """Each query goes to the child on its side first, then to the other if it may pay."""
        if not len(rows):
            return
        start, end, inside, outside, vantage = self.tree.nodes[node]
        if inside < 0:
            self._leaf(int(start), int(end), rows)
            return
        in_low, in_high, out_low, out_high = self.tree.ranges[node]
        away = self._away(rows, vantage)
        near = away <= (in_high + out_low) / 2
        bounds = {inside: (in_low, in_high), outside: (out_low, out_high)}
        self.visit(inside, rows[near])
        self.visit(outside, rows[~near])
        for child, side in ((outside, near), (inside, ~near)):
            self.visit(child, self._alive(rows[side], away[side], *bounds[child]))

    def _leaf(self, start: int, end: int, rows: np.ndarray) -> None:
        x, ids = self.tree.vectors[start:end], self.tree.ids[start:end]
        rough = self.q[rows] @ x.T
        self.compared += rough.size
        may = (rough >= (self.score[rows, -1] - self.slack[rows])[:, None]) & (ids[None, :] != self.own[rows][:, None])
        at, col = np.nonzero(may)
        if not len(at):
            return
        # the measure itself, in one order of summation for every pair
        exact = (self.q[rows[at]] * x[col]).sum(axis=1)
        touched = np.unique(at)
        r = rows[touched]
        which = np.concatenate((np.repeat(r, self.k), rows[at]))
        score = np.concatenate((self.score[r].ravel(), exact))
        found = np.concatenate((self.id[r].ravel(), ids[col]))
        best = np.lexsort((found, -score, which))
        which, score, found = which[best], score[best], found[best]
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        take = first[:, None] + np.arange(self.k)
        self.score[which[first]], self.id[which[first]] = score[take], found[take]


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite throughout and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(rows: DataFrame, key: str, schema: str, pack) -> DataFrame:
    return rows.groupBy("dim", key).applyInPandas(pack, schema)


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["vector"].tolist(), np.float64)


def build_index(vectors: DataFrame, leaf: int = LEAF, shard: int = SHARD) -> DataFrame:
    """One row per shard: dim, shard, tree. ``vectors`` has id, dim, vector (array<double>)."""
    shards = max(1, -(-vectors.count() // shard))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = Tree.build(rows["id"].to_numpy(), _matrix(rows), leaf).to_bytes()
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "tree": [tree]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return common.saved(_packed(dealt, "shard", "dim int, shard long, tree binary", grow))


def search_index(index: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows of the index for each query
    (id, dim, vector), a row of the query's own id left out."""
    blocks = max(1, -(-queries.count() // block))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.savez(out, ids=rows["id"].to_numpy(), vectors=_matrix(rows))
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "block": rows["block"].iloc[:1], "queries": [out.getvalue()]})

    packed = _packed(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "block", "dim int, block long, queries binary", gather)
    trees = index.select("dim", "shard").distinct()  # small: numbers only

    @F.pandas_udf("array<struct<query_id:long,vec_id:long,score:double>>")
    def best(tree: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for t, a in zip(tree, asked):
            with np.load(io.BytesIO(a)) as f:
                ids, vectors = f["ids"], f["vectors"]
            s = Tree.from_bytes(t).search(ids, vectors, k, factor)
            at, col = np.nonzero(np.isfinite(s.score))
            out.append([{"query_id": q, "vec_id": v, "score": x} for q, v, x in zip(ids[at].tolist(), s.id[at, col].tolist(), s.score[at, col].tolist())])
        return pd.Series(out)

    # the stated queries against all rows, in blocks: a row for each tree and block
    met = packed.join(trees, "dim").repartition("shard", "block").join(index, ["dim", "shard"])
    found = met.select(F.inline(best("tree", "queries")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def prepared(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, vector of the usable rows, each id once."""
    v = common.col(vector_col)
    kept = rows.select(common.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    return kept.groupBy("id").agg(F.min("v").alias("v")).select("id", F.size("v").alias("dim"), F.col("v").cast("array<double>").alias("vector"))


def op6_vantage_point_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20."""
    vectors = common.saved(prepared(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return search_index(build_index(vectors), vectors.filter("id % 20 = 0"))

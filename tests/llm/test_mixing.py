"""Raking and sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing


def test_raked_marginals_meet_feasible_targets(spark):
    cells = spark.createDataFrame([("a", "x", 600), ("a", "y", 200), ("b", "x", 100), ("b", "y", 100)], "s string, l string, n long")
    targets = {"s": spark.createDataFrame([("a", 3), ("b", 1)], "s string, part long"), "l": spark.createDataFrame([("x", 1), ("y", 1)], "l string, part long")}
    rows = mixing.rake(cells, ["s", "l"], targets, keep=0.4, rounds=30).collect()
    total = {k: sum(r.w for r in rows if k in (r.s, r.l)) / mixing.UNIT for k in "abxy"}
    assert total["a"] == pytest.approx(300, rel=0.01) and total["b"] == pytest.approx(100, rel=0.01)
    assert total["x"] == pytest.approx(200, rel=0.01) and total["y"] == pytest.approx(200, rel=0.01)
    assert all(0 <= r.w <= r.n * mixing.UNIT for r in rows)


def plain_rake(n, idx, parts, keep):
    """Clipped targets by bisection, then the rounds in numpy; idx and parts by dimension."""
    cap = n * mixing.UNIT
    wants = []
    for ix, part in zip(idx, parts):
        held = np.bincount(ix, cap, minlength=len(part))
        low, high = 0.0, 1e15
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if np.minimum(held, mid * part).sum() < cap.sum() * keep else (low, mid)
        wants.append(np.minimum(held, high * part))
    x, w = cap.copy(), cap.copy()
    for _ in range(mixing.ROUNDS):
        for ix, want in zip(idx, wants):
            has = np.bincount(ix, w, minlength=len(want))
            x = x * np.where(has > 0, want / np.maximum(has, 1), 0)[ix]
            w = np.minimum(cap, np.floor(x + 0.5))
        off = [np.max(np.abs(np.bincount(ix, w, minlength=len(t)) - t) / np.maximum(t, 1)) for ix, t in zip(idx, wants)]
        if max(off) <= mixing.TOLERANCE:
            break
    return w, wants, max(off)


@pytest.mark.parametrize("seed, feasible", [(1, True), (2, True), (3, False)])
def test_targets_beyond_supply_are_spread_as_in_plain_numpy(spark, seed, feasible):
    rng = np.random.default_rng(seed)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(5)))
    n = rng.integers(2000, 4000, 30).astype(float)
    if not feasible:
        n[(a != 0) & (b == 0)] = 0  # b=0 only within a=0
    parts = [rng.integers(50, 100, 6).astype(float), rng.integers(80, 120, 5).astype(float)]
    parts[0][1] = 5000  # far beyond what the value holds: all of it is taken
    if not feasible:
        parts[0][0], parts[1][0] = 1, 5000
    want_w, wants, off = plain_rake(n, (a, b), parts, 0.5)
    cells = spark.createDataFrame([(f"a{i}", f"b{j}", int(k)) for i, j, k in zip(a, b, n)], "a string, b string, n long")
    targets = {d: spark.createDataFrame([(f"{d}{i}", int(x)) for i, x in enumerate(p)], f"{d} string, part long") for d, p in zip("ab", parts)}
    raked = mixing.rake(cells, ["a", "b"], targets, keep=0.5)
    got = {(r.a, r.b): r.w for r in raked.collect()}
    assert np.allclose([got[f"a{i}", f"b{j}"] for i, j in zip(a, b)], want_w, rtol=1e-6, atol=50)
    for r in mixing.marginals(raked, ["a", "b"]).collect():
        want = wants["ab".index(r.dimension)][int(r.value[1:])]
        assert r.target == pytest.approx(want, rel=1e-6, abs=1)
        assert not feasible or abs(r.reached - want) <= mixing.TOLERANCE * max(want, 1)
    assert (off <= mixing.TOLERANCE) == feasible


def test_marginals_of_the_documents_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    cells = docs.select(*(c.alias(d) for d, c in dims.items()), mixing.word_count(F.col("text")).alias("n")).groupBy(*dims).agg(F.sum("n").alias("n")).cache()
    raked = mixing.rake(cells, list(dims), {d: mixing.tempered(cells, d) for d in dims})
    rows = mixing.marginals(raked, list(dims)).collect()
    assert all(abs(r.reached - r.target) <= 0.01 * r.target for r in rows)
    total = cells.agg(F.sum("n")).first()[0] * mixing.UNIT
    assert sum(r.reached for r in rows if r.dimension == "topic") == pytest.approx(mixing.KEEP * total, rel=0.005)


def test_sample_follows_the_probabilities(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "'w w w w' as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 5) end as source", "if(id % 7 = 0, null, 'en') as lang", "1 as mix")
    out = mixing.mix(docs.drop("mix"), {"source": F.col("source"), "lang": F.col("lang")}, mixing.word_count(F.col("text")))
    rows = out.groupBy("mix.source", "mix.lang").agg(F.count("*").alias("n"), F.avg("mix.probability").alias("p"), F.avg(F.col("mix.kept").cast("int")).alias("k")).collect()
    assert len(rows) == 12 and all(abs(r.p - r.k) < 0.06 for r in rows)
    assert abs(sum(r.n * r.p for r in rows) / 20000 - mixing.KEEP) < 0.01
    kept = mixing.sample_mixture(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < 20000


def test_nulls_repeats_empty_texts_and_empty_table(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (None, "a b", "s", "en"), (2, "", "s", "en"), (3, "c", "t", None)], "doc_id long, text string, source string, lang string")
    for bound in (mixing.BROADCAST_CELLS, 0):
        monkeypatch.setattr(mixing, "BROADCAST_CELLS", bound)
        rows = mixing._documents(df).collect()
        assert len(rows) == 5 and all(0 <= r.mix.probability <= 1 for r in rows)
        assert [r.mix.probability for r in rows if r.doc_id == 1] == [1.0, 1.0]
    assert mixing.sample_mixture(df.limit(0)).count() == 0


def test_very_long_texts_and_cells_without_tokens(spark):
    rows = [(1, "w " * 300_000, "a", "x"), (2, "w " * 300_000, "b", "x"), (3, None, "c", "x"), (4, "", "c", "y")] + [(10 + i, "w w", "a", "y") for i in range(20)]
    out = mixing._documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    assert {r.doc_id: r.mix.n_tokens for r in out}[1] == 300_000
    assert all(r.mix.probability == 1.0 for r in out if r.doc_id in (3, 4)) and all(0 <= r.mix.probability <= 1 for r in out)

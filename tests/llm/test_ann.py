"""Nearest neighbours against brute force."""

import numpy as np

from quarry.llm import ann


def brute(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        o = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in o]
    return out


def test_whole_table_is_exact(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.array(t.embedding.tolist(), float)
    want = brute(t.vec_id.to_numpy(), x)
    rows = sorted(ann.op6_vantage_point_ann(spark, sf_dir).collect(), key=lambda r: (r.query_id, r["rank"]))
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [v for v, _ in g] for q, g in got.items()} == {q: [v for v, _ in g] for q, g in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_ties_norms_shards_and_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((np.repeat(rng.normal(size=(1, 5)), 400, axis=0), rng.normal(size=(300, 5)) * rng.uniform(0.1, 9, (300, 1))))
    ids = rng.permutation(700)
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x)]
    odd = [(1000, None), (1020, [0.0] * 5), (1040, [1.0, None, 1.0, 1.0, 1.0]), (1060, [float("nan")] * 5), (1080, [float("inf")] * 5), (None, [1.0] * 5), (1100, []), rows[0], rows[0]]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows + odd], "vec_id long, embedding array<double>, id int")
    v = ann.prepared(df, "vec_id", "embedding").cache()
    assert v.count() == 700
    found = ann.search_index(ann.build_index(v, leaf=8, shard=150), v.filter("id % 20 = 0"), block=10)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in g] for q, g in brute(ids, x).items()}


def test_fewer_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0])], "vec_id long, embedding array<float>")
    v = ann.prepared(df, "vec_id", "embedding")
    assert [tuple(r) for r in ann.search_index(ann.build_index(v), v.filter("id % 20 = 0")).collect()] == [(0, 1, 1, 4.0)]
    none = ann.prepared(df.limit(0), "vec_id", "embedding")
    assert ann.search_index(ann.build_index(none), none).count() == 0


def test_factor_trades_recall_for_work():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 8))
    ids = np.arange(4000)
    tree = ann.Tree.from_bytes(ann.Tree.build(ids, x).to_bytes())
    exact, relaxed = (tree.search(ids[::20], x[::20], 20, f) for f in (1.0, 3.0))
    want = brute(ids, x)
    assert all([int(v) for v in exact.id[i]] == [v for v, _ in want[q]] for i, q in enumerate(ids[::20].tolist()))
    assert relaxed.compared < exact.compared < 200 * 4000
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(exact.id, relaxed.id)]) > 0.5

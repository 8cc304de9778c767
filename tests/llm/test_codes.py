"""Vector codes against plain Python over all entries."""

import hashlib
import math

import numpy as np
import pytest

from quarry.llm import codes


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label), all usable and of one length."""
    whole = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows]
    w = len(whole[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in whole]
    first = sorted(range(len(whole)), key=lambda k: (whole[k][0] is None, whole[k][0] or 0, whole[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(of[i]) for col in zip(*of[i])] if i in of else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    best = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in b) for b in best]
    total = {}
    for (_, _, label), e in zip(whole, error):
        total[label] = total.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in b), x, total[label], digest) for (i, _, label), b, x in zip(whole, best, error)), key=str)


def result(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, codes.op13_orchard_codes(spark, str(tmp_path)).collect()), key=str)


def test_ties_repeats_nulls_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 8)), 1)  # a coarse grid: many equal distances
    rows = [(int(i), [float(c) for c in v], int(i) % 3 or None) for i, v in enumerate(x)]
    rows += [rows[0], rows[0], (5, rows[7][1], 1), (None, rows[9][1], None)] + [(900 + i, [0.25] * 8, 2) for i in range(300)]
    odd = [(1000, None, 1), (-1, [1.0, None] * 4, 1), (-2, [float("nan")] * 8, 1), (-3, [float("inf")] + [0.0] * 7, None), (-4, [1e9] * 8, None)]
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows + odd], "vec_id long, embedding array<double>, label int, code string, error int")
    assert result(spark, df, tmp_path) == brute(rows)


def test_few_rows(spark, tmp_path):
    rows = [(3, [0.5, -0.25, 1.0, 0.0], None), (1, [0.1, 0.2, 0.3, 0.4], "a"), (2, [-0.1, 0.2, 0.3, 0.4], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert result(spark, df, tmp_path) == brute([(i, np.float32(v).astype(float).tolist(), label) for i, v, label in rows])


def test_empty_table_and_uneven_lengths(spark, tmp_path):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert result(spark, df, tmp_path / "none") == []
    rows = [(1, [0.5, 1.0, 1.5], 1), (2, [], 1), (3, [0.25] * 6, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(spark, df, tmp_path / "uneven") == brute([(i, v + [0.0] * (8 - len(v)), label) for i, v, label in rows])


@pytest.mark.parametrize("k", [1, 2, 60, 256])
def test_search_is_exact_and_prunes(k):
    rng = np.random.default_rng(k)
    centres = rng.integers(-4000, 4000, (12, 6))
    entries = centres[rng.integers(0, 12, k)] + rng.integers(-40, 40, (k, 6))
    entries[-1] = entries[0]
    parts = np.concatenate((centres[rng.integers(0, 12, 5000)] + rng.integers(-60, 60, (5000, 6)), entries))
    book = codes.Codebook(entries)
    near, dist = book.nearest(parts)
    every = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (near == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
    if k == 256:
        assert book.measured < every.size / 3


def test_decode_gives_the_entries(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(50, 8)))], "vec_id long, embedding array<double>, label int")
    coded, books = codes.compress(df)
    for r in coded.withColumn("vector", codes.decode(coded["code"], books)).collect():
        assert r.vector == [x / 1024 for p, c in enumerate(r.code) for x in books.entries[p][c]]

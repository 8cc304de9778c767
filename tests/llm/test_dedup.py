"""Near-duplicates against all pairs compared by brute force."""

import random

import numpy as np
import pytest

from quarry.llm import dedup, shingles


def sets_of(texts):
    out = []
    for t in texts:
        w = [x for x in (t or "").encode().lower().split()]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(ids, texts):
    sets = sets_of(texts)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if ids[i] == ids[j] or a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(ids[i]), root(ids[j])
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, [len(s) for s in sets]


def family(rng, n, words, edits):
    """Copies of one text with random words replaced: similarities on both sides of 0.75."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_families_on_both_sides_of_the_threshold(spark):
    rng = random.Random(11)
    texts = family(rng, 120, 150, 12) + family(rng, 60, 60, 4) + [f"own text number {i} with words {i * 7} and {i * 13} more" for i in range(40)]
    texts += ["a b", "A B", "a  b\n", "a b c d e", "", None, " \t", "Straße", "straße", "STRASSE"]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    want, sizes = brute(ids, texts)
    df = spark.createDataFrame(list(zip(ids, texts, [0] * len(ids))), "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in dedup.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == dict(zip(ids, sizes))
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(dedup, "BROADCAST_IDS", 0)
    rng = random.Random(5)
    texts = family(rng, 150, 100, 9)
    ids = list(range(len(texts)))
    want, _ = brute(ids, texts)
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_repeated_and_missing_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, a), (5, a), (7, a), (7, b), (9, b), (None, a), (None, a), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True)] * 2 + [(7, 5, False)] * 2 + [(9, 5, False)] + [(None, None, True)] * 2 + [(3, 3, True)] * 2, key=str)
    kept = dedup.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [3, 5, None, None]
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def test_all_rows_empty(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in dedup.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 5000])
def test_sketch_fills_and_estimates(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 2**63, n, dtype=np.uint64)
    assert len(shingles.fast_sketch(a)) == 128
    b = np.concatenate((a[: max(1, n * 3 // 4)], rng.integers(0, 2**63, n // 8, dtype=np.uint64)))
    same = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    agree = (shingles.fast_sketch(np.unique(a)) == shingles.fast_sketch(np.unique(b))).mean()
    assert abs(agree - same) < 0.2
    assert (shingles.fast_sketch(a) == shingles.fast_sketch(np.random.default_rng(0).permutation(a))).all()


def test_word_hashes_do_not_depend_on_the_place():
    long = "x" * 200_000
    t = f"Foo bar {long} foo\tBAR {long} end"
    h = shingles.word_hashes(t)
    assert len(h) == 7 and h[0] == h[3] and h[1] == h[4] and h[2] == h[5] and len(set(h.tolist())) == 4
    assert shingles.word_hashes(None).size == shingles.word_hashes(" \n").size == 0
    many = shingles.word_hashes(" ".join(["alpha", "beta"] * 40_000))
    assert len(set(many.tolist())) == 2 and len(many) == 80_000

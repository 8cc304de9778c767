"""Importance resampling against plain Python, word by word."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import importance


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % importance.BUCKETS for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, goal, percent=25, least=20):
    b = importance.BUCKETS
    s, t = (Counter(f for x in texts for f in features(x)) for texts in ([x for _, x in docs], goal))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s_all + b) / ((s[i] + 1) * (t_all + b)))) for i in range(b)]
    rows = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, len(words(x)) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    goal = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted(map(tuple, importance.op11_importance_resampling(spark, sf_dir).collect()), key=str)
    assert got == brute(docs, goal)


@pytest.mark.parametrize("slice_size", [1, 2, 7, importance.SLICE])
def test_batches_slices_and_boundaries(monkeypatch, slice_size):
    monkeypatch.setattr(importance, "SLICE", slice_size)
    texts = ["", "one", "Two words", "a, B-c d'e\x00f", "Äpfel ÄPFEL 中文 x", "   ", "end", "x " * 50, "\n\n", "İ ſ k"]
    counts = importance.bucket_counts([t.encode() for t in texts])
    want = Counter(f for t in texts for f in features(t))
    assert {i: int(n) for i, n in enumerate(counts) if n} == want
    import numpy as np

    gains = np.arange(importance.BUCKETS) - 5000
    n_words, n_features, weight = importance.batch_weights([t.encode() for t in texts], gains)
    for i, t in enumerate(texts):
        f = features(t)
        assert (n_words[i], n_features[i]) == (len(words(t)), len(f))
        assert weight[i] == (sum(int(gains[k]) for k in f) // len(f) if f else 0)


def test_longer_grams_do_not_cross_documents(monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 2)
    texts = [b"a b c d", b"e", b"f g h"]
    got = Counter()
    for _, grams in importance.batch_features(texts, 3, 1 << 32):
        for doc, bucket in grams:
            got.update(zip(doc.tolist(), bucket.tolist()))
    want = Counter()
    for i, t in enumerate(texts):
        w = t.split()
        want.update((i, zlib.crc32(b" ".join(w[k : k + n]))) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    assert got == want


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    same = " ".join(f"k{i}" for i in range(25))
    rows = [(1, same), (1, same), (2, same), (3, None), (4, ""), (None, same), (None, None), (5, long), (6, same.upper()), (7, "few words")]
    rows += [(100 + i, same) for i in range(40)]
    df = spark.createDataFrame([(a, b, 0, "x", 1) for a, b in rows], "doc_id long, text string, score int, rank string, id int")
    goal = spark.createDataFrame([("k1 k2 w3",), (None,), ("",)], "text string")
    got = sorted(map(tuple, importance.resample(df, goal).collect()), key=str)
    assert got == brute(rows, ["k1 k2 w3", None, ""])


def test_tied_scores_go_to_the_smaller_id(spark):
    rows = [(i, 30, 5, 5, score) for i, score in enumerate([7, 9, 9, 9, 7, 7, 300, -300])] + [(99, 3, 5, 5, 900)]
    scored = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long")
    rank = {r.id: r["rank"] for r in importance.draw(scored, percent=75).collect()}
    assert rank == {6: 1, 1: 2, 2: 3, 3: 4, 0: 5, 4: 6, 5: None, 7: None, 99: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    goal = spark.createDataFrame([], "text string")
    assert importance.resample(docs, goal).count() == 0
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [tuple(r) for r in importance.resample(one, goal).collect()] == brute([(1, "a " * 30)], [])

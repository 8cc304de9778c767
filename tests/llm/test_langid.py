"""Language identification: held-out accuracy, mixtures, edge cases."""

import zlib
from itertools import combinations
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = langid.op7_language_id(spark, d).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


TEXT = {"en": "the weather with which that thing was there and then", "fr": "le château est là où les élèves étudient avec une voix", "de": "die straße über den fluss ist nicht für schwere wagen"}


def test_mixture_and_edge_cases(spark):
    rows = [(i, t, l) for i, (l, t) in enumerate(TEXT.items())] * 5 + [(90, TEXT["en"], None), (91, None, "en"), (92, "123 !?", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en", "fr")
    both = model.mixture(" ".join([TEXT["en"], TEXT["fr"]] * 6))
    assert {x for x, _ in both} == {"en", "fr"} and abs(both[0][1] - 0.5) < 0.2
    assert [x for x, _ in model.mixture(TEXT["de"] * 4)] == ["de"]
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "42 % !"), (None, TEXT["de"].upper()), (4, "the " * 20000)], "doc_id long, text string")
    got = [(r.doc_id, r.p.lang_pred, r.p.score) for r in df.select("doc_id", langid.predict(F.col("text"), model).alias("p")).collect()]
    assert got[:4] == [(1, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert got[4][:2] == (None, "de") and got[5][1] == "en"


def plain_em(rows, count):
    """Proportions and log-likelihood by the formula, number by number."""
    share, total = [1 / len(rows)] * len(rows), sum(count)
    for _ in range(langid.STEPS if len(rows) > 1 else 0):
        new = [0.0] * len(rows)
        for g, c in enumerate(count):
            whole = sum(s * r[g] for s, r in zip(share, rows))
            for k, r in enumerate(rows):
                new[k] += c / total * share[k] * r[g] / whole
        moved = max(abs(a - b) for a, b in zip(new, share))
        share = new
        if moved < langid.TOLERANCE:
            break
    return share, sum(c * log(sum(s * r[g] for s, r in zip(share, rows))) for g, c in enumerate(count))


def test_mixtures_against_plain_em_over_every_set(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("lang is not null")
    model = langid.fit(docs)
    dense = {r.lang: np.zeros(langid.BUCKETS) for r in docs.select("lang").distinct().collect()}
    sample = docs.where("length(text) between 200 and 3000").orderBy("doc_id").limit(60).collect()
    for r in docs.select("lang", "text").collect():
        dense[r.lang] += np.bincount(langid.grams(r.text), minlength=langid.BUCKETS)
    assert model.languages == tuple(sorted(dense))
    table = np.array([(dense[k] + langid.SMOOTH) / (dense[k].sum() + langid.SMOOTH * langid.BUCKETS) for k in model.languages])
    ids = np.arange(langid.BUCKETS)
    assert np.array_equal(model.likely(ids), table)
    texts = [r.text for r in sample[:6]] + [a.text + " " + b.text for a, b in zip(sample[::6], sample[3::6])]
    for text in texts:
        ids, count = np.unique(langid.grams(text), return_counts=True)
        rows, count = table[:, ids].tolist(), count.tolist()
        cost = langid.PENALTY * log(sum(count) + 1)
        best = max(
            (plain_em([rows[k] for k in some], count)[1] - cost * (len(some) - 1), some)
            for n in range(1, len(rows) + 1) for some in combinations(range(len(rows)), n)
        )[1]
        share, _ = plain_em([rows[k] for k in best], count)
        got = model.mixture(text)
        assert sorted(x for x, _ in got) == sorted(model.languages[k] for k in best)
        assert dict(got) == pytest.approx({model.languages[k]: s for k, s in zip(best, share)}, abs=1e-6)


def test_letters_are_category_l(spark):
    rows = [(1, "abc abd", "b", 1), (2, "abc abd", "a", 1), (3, "xyz", None, 1)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, bucket int").withColumn("n", F.lit(3)))
    assert all(model.mixture(t) == [] for t in ("²", "½ ①", "Ⅷ", "١٢", "_", "́"))
    assert [x for x, _ in model.mixture("abc")] == ["a"]  # equal models: the first name
    assert model.mixture("ª") and model.mixture("中") and model.mixture("ʰ")


def test_a_model_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_PAIRS", 3)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([("abcdef", "a")], "text string, lang string"))


def test_nothing_learned_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    assert model.languages == () and model.mixture("some text") == []
    assert none.select(langid.predict(F.col("text"), model)).count() == 0

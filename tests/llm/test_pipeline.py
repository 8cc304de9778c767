"""The pipeline against its stages by brute force, and the registration guard."""

import hashlib
import re

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from quarry.llm import common, dedup, mixing, packing, pii, quality

import test_dedup
import test_mixing
import test_packing
import test_pii
import test_quality


def brute_sample(rows):
    """The ids that the raked mixture of source, language and topic keeps, in numpy."""
    def topic(t):
        return "table" if " | " in t else "license" if "License" in t else "contact" if "@" in t or re.search(r"\+[0-9]", t) else "prose"

    cells = [(r.source, r.lang, topic(r.text)) for r in rows]
    names = sorted(set(cells), key=str)
    of = [names.index(c) for c in cells]
    n = np.bincount(of, [len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows])
    idx, parts = [], []
    for d in range(3):
        values = sorted({c[d] for c in names}, key=str)
        idx.append(np.array([values.index(c[d]) for c in names]))
        parts.append(np.floor(np.bincount(idx[d], n) ** mixing.TEMPERATURE * 1000 + 0.5))
    w, wants, off = test_mixing.plain_rake(n, idx, parts, mixing.KEEP)
    for ix, want in zip(idx, wants):
        assert (np.abs(np.bincount(ix, w) - want) <= max(off, mixing.TOLERANCE) * want + 1).all()
    p = np.where(n > 0, w / np.maximum(n * mixing.UNIT, 1), 1.0)
    u = [int(hashlib.sha256(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32 for r in rows]
    assert all(abs(x - p[c]) > 1e-6 for x, c in zip(u, of))
    return [r.doc_id for r, x, c in zip(rows, u, of) if x < p[c]]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "minhash_near_dedup", "pii", "source_mixing", "best_fit_packing"]

    good = stages["quality_rules"](spark, docs, sf_dir).cache()
    assert good.columns == columns
    bits = {r.doc_id: quality.measure_text(r.text) for r in docs.collect()}
    assert all(bits[r.doc_id] == test_quality.brute(r.text) for r in docs.limit(40).collect())
    kept = {i for i, m in bits.items() if m[0] >= 50 and 2 * m[5] <= m[0] and 20 * m[2] <= m[1] and 2 * m[4] <= m[3] and 10 * m[1] >= 25 * m[0] and m[1] <= 15 * m[0] and not (m[0] >= 200 and 20 * m[6] < m[0])}
    assert {r.doc_id for r in good.collect()} == kept

    one = stages["minhash_near_dedup"](spark, good, sf_dir).cache()
    rows = good.collect()
    group, _ = test_dedup.brute([r.doc_id for r in rows], [r.text for r in rows])
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(group.values())) and one.columns == columns

    masked = stages["pii"](spark, one, sf_dir).cache()
    assert masked.columns == columns and masked.count() == one.count()
    before = {r.doc_id: r.text for r in one.collect()}
    for r in masked.collect():
        assert test_pii.base(r.text) == [] and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or pii.BASE and test_pii.base(before[r.doc_id])

    mixed = stages["source_mixing"](spark, masked, sf_dir).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in masked.collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(brute_sample(masked.collect()))

    packed = stages["best_fit_packing"](spark, mixed, sf_dir).collect()
    want = sorted(p for r in mixed.collect() for p in test_packing.brute_pieces(r.doc_id, r.text))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    test_packing.check(packed)

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r[:5] for r in whole) == want


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
    assert dedup and packing


def test_stages_on_odd_documents(spark):
    """Nulls everywhere, empty and repeated rows, long texts, columns named like the stages' own."""
    words = " ".join(f"word{i}" for i in range(120))
    rows = [(1, words, "en", "a", 5, 1), (1, words, "en", "a", 5, 1), (2, words, None, None, None, 2), (None, words + " more", "en", "a", 5, 3), (None, None, None, None, None, 4),
            (3, "", "en", "b", 0, 5), (4, words.replace("word", "x@y.zz "), "fr", None, 9, 6), (5, " ".join(f"long{i}" for i in range(30000)), "en", "a", 1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mix long").selectExpr("*", "1 as q", "'k' as keep_id", "2 as p", "3 as `group`")
    good = common.saved(quality.keep_good(docs))
    assert good.columns == docs.columns and sorted((r.doc_id for r in good.collect()), key=str) == [1, 1, 2, 4, 5, None]
    one = common.saved(dedup.keep_one(good))
    assert one.columns == docs.columns and sorted((r.doc_id for r in one.collect()), key=str) == [1, 4, 5, None]
    masked = common.saved(pii.mask_pii(one))
    assert masked.columns == docs.columns and all(test_pii.base(r.text) == [] and r.n_chars == len(r.text) for r in masked.collect())
    mixed = common.saved(mixing.sample_mixture(masked))
    assert mixed.columns == docs.columns and mixed.count() <= 4
    packed = packing.pack_documents(masked).collect()
    n, tokens = test_packing.check(packed)
    assert n >= 1 and tokens == sum(p[3] for r in masked.collect() for p in test_packing.brute_pieces(r.doc_id, r.text))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_masking_stage_leaves_no_phone_beside_an_address(spark):
    docs = spark.createDataFrame([(1, "+1 (826) 555-4081 190.137.223.204", "en", "a", 33)], "doc_id long, text string, lang string, source string, n_chars long")
    row = dict(corpus_pipeline.STAGES)["pii"](spark, docs, "").first()
    assert row.text == "<PHONE> <IP>" and row.n_chars == len(row.text) and test_pii.base(row.text) == []

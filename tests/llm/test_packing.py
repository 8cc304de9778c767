"""Packing: pieces against the library, sequences full, gapless and few."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing

LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, capacity=2048):
    """Sequences hold their pieces without gap or overlap; returns their number and the tokens."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def brute_pieces(doc_id, text):
    ids = [*LIB.encode(text or "", add_special_tokens=False).ids, 0]
    for k, at in enumerate(range(0, len(ids), 2048)):
        part = np.array(ids[at : at + 2048], "<u4")
        yield doc_id, k, at, len(part), zlib.crc32(part.tobytes())


def test_whole_table_against_the_library(spark, sf_dir):
    rows = packing.op10_best_fit_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = sorted(p for d in docs for p in brute_pieces(d.doc_id, d.text))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n, tokens = check(rows)
    assert n <= -(-tokens // 2048) * 1.02 + 1


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    long = "word " * 5000
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "", 2), (None, "x", 3), (2, long, 4), (2, long, 4)], "doc_id long, text string, group int")
    rows = packing.pack_documents(df).collect()
    check(rows)
    assert sorted(r.length for r in rows) == [1, 1, 1, 2, 905, 905, 2048, 2048, 2048, 2048]
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_a_worker_that_forgets_gives_the_same_pieces(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    both = [packing.pieces(docs, keep_words=keep).collect() for keep in (True, False)]
    assert sorted(map(tuple, both[0])) == sorted(map(tuple, both[1]))


def test_many_groups_stay_bounded_with_one_hot_row(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'same text' as text")
    out = packing.pack_documents(df, group_items=500)
    rows = out.collect()
    n, tokens = check(rows)
    assert len(rows) == 3000 and n <= -(-tokens // 2048) + 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_search_only_raises_the_squared_fill(lengths):
    bins = packing.Bins(40)
    bins.fill(np.array(lengths, np.int64))
    before, n = sum((40 - r) ** 2 for r in bins.room), len(bins.items)
    bins.improve()
    used = [sum(x for x, _ in items) for items in bins.items]
    assert all(u + r == 40 for u, r in zip(used, bins.room))
    assert sum(u * u for u in used) >= before and sum(u > 0 for u in used) <= n
    assert sorted(i for items in bins.items for _, i in items) == list(range(len(lengths)))


def test_search_empties_a_sequence():
    bins = packing.Bins(10)
    bins.items = [[(6, 0)], [(4, 1), (3, 2)], [(3, 3), (3, 4)], [(5, 5)]]
    bins.room = [4, 3, 4, 5]
    bins.improve()
    assert sum(1 for items in bins.items if items) == 3


def _lengths(seed, n, low, high, same=0.0):
    r = np.random.default_rng(seed)
    return np.where(r.random(n) < same, 700, r.integers(low, high + 1, n))


def test_search_ends_only_where_no_step_helps():
    for lengths in (_lengths(1, 1000, 600, 760), _lengths(2, 1000, 400, 1000, 1 / 3), _lengths(3, 1000, 500, 900), np.full(1000, 700)):
        bins = packing.Bins(2048)
        bins.fill(lengths)
        first = sum(1 for items in bins.items if items)
        bins.improve()
        under = [b for b, items in enumerate(bins.items) if items and bins.room[b]]
        assert sum(1 for items in bins.items if items) <= first
        assert not any(bins._step(s, p) for s in under for p in under if s != p and bins.room[p] <= bins.room[s])


def test_full_pieces_are_in_no_group_of_the_search(spark):
    items = spark.range(12000, numPartitions=3).selectExpr("id", "cast(if(id % 400 = 0, 7 + id % 90, 2048) as long) as length")
    rows, group, _ = packing.dealt(items, 2048, "length", 50, 1)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.max("length").alias("most")).collect()
    assert max(r.n for r in sizes) <= 50 and all((r[0] < 0) == (r.most == 2048) for r in sizes)
    out = packing.pack(items, group_items=50, groups=1).collect()
    n, tokens = check(out)
    full = [r.sequence_id for r in out if r.length == 2048]
    assert len(out) == 12000 and tokens == items.agg(F.sum("length")).first()[0]
    assert len(set(full)) == len(full) == 11970 and max(full) < 0 and n == 11971

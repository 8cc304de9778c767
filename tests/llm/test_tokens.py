"""Token counts and ids against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, tokens
from quarry.llm.packing import WordIds

LIB = Tokenizer.from_file(public_tokenizers.path(bpe.FILE))
POOL = "aAbB'sStT rRvVeEmlLdD 0123ÀéÉßΣςσİıſḰ \t\n\x0b\x1c\x1f\x85\xa0中文字🙂½²Ⅷ٣.,!?-—\u0000ﬁǅ"
ODD = ["", " ", "it's we'll I'D", "<|endoftext|>", "a<|endoftext|><|startoftext|>B", "<|ENDOFTEXT|>", "ΣΑΣ Σ", "x" * 5000, "a" * 300 + "1" * 300, "\x1c a\x1fb", "\U000378ab z"]


def samples():
    random.seed(7)
    out = list(ODD)
    for i in range(2000):
        s = "".join(random.choice(POOL) for _ in range(random.randint(0, 25)))
        out.append(s[:8] + "<|endoftext|>" + s[8:] if i % 5 == 0 else s)
    return out


def ids(t):
    return np.array(LIB.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("memory", [3, 100_000])
def test_counts_and_ids_equal_the_library(memory):
    texts = samples()
    assert list(bpe.WordCounter(memory=memory).counts(texts)) == [len(ids(t)) // 4 for t in texts]
    assert list(WordIds(memory=memory).ids(texts)) == [ids(t) for t in texts]


def test_whole_table(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = tokens.op3_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        n = len(ids(text[r.doc_id])) // 4
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text[r.doc_id].encode()), n > 2048)


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6)], "doc_id long, text string, n_tokens int")
    got = sorted((r.n_tokens, r.n_bytes) for r in tokens.count_tokens(df).collect())
    assert got == [(0, 0), (0, 0), (2, 3)]
    assert tokens.count_tokens(df.limit(0)).count() == 0


def test_merging_order():
    ranks = {("a", "b"): 0, ("b", "c"): 1, ("ab", "c"): 2, ("a", "a"): 3}
    assert bpe.merge_count(list("abc"), ranks) == 1
    assert bpe.merge_count(list("bcab"), ranks) == 2
    assert bpe.merge_count(list("aaa"), ranks) == 2
    assert bpe.merge_count(["x"], ranks) == 1

"""Byte-level ids against the tiktoken library; appends and edits against fresh tables."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quarry.llm import prefix_bpe

with open(public_tokenizers.path(prefix_bpe.FILE), "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
POOL = "aAbBeEnNsStT rRvVlLdDiou 0123ÀéÉßΣςσИжия \t\n\r\x0b\x1c\x1f\x85\xa0  中文字日本語🙂👍🏽½²Ⅷ٣।,!?-—'’\u0000ﬁǅ"
ODD = ["", " ", "   ", "\n\n  x", "it's we'll I'D", "<|endoftext|>", "a" * 3000, " " * 3000 + "b", "=" * 997, "ab" * 700, "1234567890" * 90, "\x1c a\x1fb", "﻿x", "end  "]


def samples(n=3000):
    random.seed(5)
    return ODD + ["".join(random.choice(POOL) for _ in range(random.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return prefix_bpe.Encoder()


@pytest.mark.parametrize("memory", [3, 100_000])
def test_ids_equal_the_library_and_decode_back(memory):
    texts = samples()
    e = prefix_bpe.Encoder(memory=memory)
    for text, ids in zip(texts, e.encode_all(texts), strict=True):
        assert ids.tolist() == LIB.encode_ordinary(text)
        assert e.decode(ids) == text.encode()


def test_cut_of_every_character(encoder):
    """Code points beside a letter, a digit, a mark and blanks are cut as the library cuts them:
    all of the first 12,288 and every seventh beyond."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    for block in range(0, len(points), 4096):
        text = "\n".join(f"a{chr(c)}b1{chr(c)} {chr(c)}!" for c in points[block : block + 4096])
        assert encoder.encode(text).tolist() == LIB.encode_ordinary(text), hex(points[block])


def test_every_token_and_random_pairs(encoder):
    v = encoder.vocabulary
    for token, rank in list(RANKS.items())[::7]:
        want = LIB._encode_single_piece(token)
        assert ([rank] if token in v.ranks else prefix_bpe.Prefixes(v, token).tokens()) == want
    random.seed(9)
    tokens = list(RANKS)
    for _ in range(3000):
        data = b"".join(random.choice(tokens) for _ in range(random.randint(2, 5)))
        if data not in RANKS:
            assert prefix_bpe.Prefixes(v, data).tokens() == LIB._encode_single_piece(data)


def test_neighbours_by_undoing_and_by_merging(encoder, tmp_path):
    v = encoder.vocabulary
    assert v.in_order
    random.seed(4)
    ids = list(v.bytes)
    near = [(a, b) for a, b in ((random.choice(ids), random.choice(ids)) for _ in range(20000))]
    for text in ODD:
        got = encoder.encode(text).tolist()
        near += zip(got, got[1:])
    for a, b in near:
        assert v.apart(a, b) == (v.merged(v.bytes[a] + v.bytes[b]) == [v.bytes[a], v.bytes[b]])
    # a vocabulary out of order: "abc" is made through "bc", which ranks above it
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"abcd": 258, b"cd": 259, b"xyz": 260}
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    odd = prefix_bpe.Encoder(str(path))
    lib = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert not odd.vocabulary.in_order
    for _ in range(500):
        text = "".join(random.choice("abcdxyz ") for _ in range(random.randint(0, 12)))
        assert odd.encode(text).tolist() == lib.encode_ordinary(text)


def test_appends_and_edits(encoder):
    v = encoder.vocabulary
    random.seed(2)
    words = "unbelievably international straße Übermut préparation aaaaaaaa réfléchissez contraception".encode()
    table = prefix_bpe.Prefixes(v)
    for i in range(len(words)):
        table.append(words[i : i + 1])
        assert table.last == prefix_bpe.Prefixes(v, words[: i + 1]).last
    long = prefix_bpe.Prefixes(v, words * 30)
    worst = 0
    for _ in range(60):
        start = random.randint(0, len(long.data))
        end = min(len(long.data), start + random.randint(0, 6))
        new = random.randbytes(random.randint(0, 3)) if random.random() < 0.3 else words[: random.randint(0, 5)]
        worst = max(worst, long.replace(start, end, new))
        fresh = prefix_bpe.Prefixes(v, long.data)
        assert long.last == fresh.last and long.tokens() == fresh.tokens()
    assert worst < len(words) * 30 / 2  # near the edit, not all that follows


def test_whole_table(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = prefix_bpe.op12_prefix_bpe(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = LIB.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_columns_nulls_repeats_long_texts_and_empty_table(spark):
    long = "a long text, " * 120_000
    rows = [(1, None, 5), (1, None, 5), (None, "a b", 6), (2, "", 1), (3, long, 1), (4, "naïve 中文 🙂", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in prefix_bpe.encode_documents(df).collect()), key=str)
    assert got == sorted(((i, LIB.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=str)
    back = df.select(prefix_bpe.decode(prefix_bpe.encode(df["text"])).alias("b")).collect()
    assert sorted(bytes(r.b) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert prefix_bpe.encode_documents(df.limit(0)).count() == 0


def test_unknown_ids_are_an_error(encoder):
    for ids in ([50256], [-1], [0, 1 << 30]):
        with pytest.raises(ValueError):
            encoder.decode(np.array(ids))

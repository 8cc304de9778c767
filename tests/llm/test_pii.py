"""Personal data against a plain Python reading of the contract."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import pii
from quarry.llm.spans import running_total

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in p.finditer(text or "") if valid(k, m.group())]


def expect(text):
    s = base(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
    return [sum(x[0] == k for x in s) for k, _ in BASE] + [hashlib.sha256(joined.encode()).hexdigest()], joined


def digest(df):
    found = pii.find_pii(df, base_out="b")
    return found.select("doc_id", "text", *(pii.count_kind(F.col("b"), k) for k in pii.BASE), F.sha2(pii.span_text(F.col("b")), 256), pii.span_text(F.col("spans")))


ODD = [
    None, "", "a@b.c", "a@b.c_d@e.f g@h", "é🙂 x.y+z@m-n.co.uk, (a@b.c)", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.01 1.2.3", "9" * 50 + ".1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111 1111 1111", "12-34", "+1 (017) 555-7713 x", "+1((((", "+12345678", "++1 2345678-",
    "+1 555 123 4567 4111-1111-1111-1111", "a" * 3000 + "@", "@" * 50, "a.b.c.d@" + "x." * 4000 + "y", "1." * 5000, "+1" * 500, "x@y.z " * 700,
    "iban: DE89 3704 0044 0532 0130 00 end", "DE89 3704 0044 0532 0130 01", "my ssn 123-45-6789, 666-12-1234", "123-45-6789", "call 555-123-4567", "amex card 378282246310005",
]


def test_odd_texts_match_plain_python(spark):
    random.seed(3)
    pool = ["a", "b", "@", ".", "-", "_", "1", "23", "255", "256", "+", "(", ")", " ", "é", "🙂", "%", "0" * 8, "4111111111111111"]
    texts = ODD + ["".join(random.choice(pool) for _ in range(random.randint(0, 40))) for _ in range(1500)]
    rows = digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want, joined = expect(r[1])
        assert list(r[2:7]) == want, r[1]
        assert (r[7] + ",").startswith(joined + "," if joined else ""), r[1]


def test_whole_table_matches_plain_python(spark, sf_dir):
    text = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.op1_pii(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        want, joined = expect(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == want
        assert r.spans == joined or r.spans.startswith(joined)


def test_further_kinds_need_checksum_or_context(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.text: {s["kind"] for s in r.spans} for r in pii.find_pii(df).collect()}
    assert "iban" in got["iban: DE89 3704 0044 0532 0130 00 end"]
    assert not got["DE89 3704 0044 0532 0130 01"]
    assert got["my ssn 123-45-6789, 666-12-1234"] == {"ssn"} and not got["123-45-6789"]
    assert got["call 555-123-4567"] == {"local_phone"} and got["amex card 378282246310005"] == {"short_card"}


LISTS = {
    "SSN 123-45-6789 and 321-54-9876": ("ssn", 2), "SSN 123-45-6789, 321-54-9876 or 456-12-3456": ("ssn", 3),
    "call 212-555-0101 or 212-555-0102": ("local_phone", 2), "call 212-555-0101, 212-555-0102, 212-555-0103": ("local_phone", 3),
    "Amex card no 12: 378282246310005": ("short_card", 1), "é🙂 ssn" + " 1-2" * 3 + " 123-45-6789": ("ssn", 1),
    "ssn" + " " * 38 + "123-45-6789": ("ssn", 0), "ssn" + " " * 37 + "123-45-6789": ("ssn", 1),
    "ssn 123-45-6789" + " " * 29 + "321-54-9876": ("ssn", 1), "card" + " 12;" * 9 + "378282246310005": ("short_card", 1), "card" + " 12;" * 10 + "378282246310005": ("short_card", 0),
}


def test_context_reaches_over_earlier_matches(spark):
    df = spark.createDataFrame([(t,) for t in LISTS], "text string")
    for r in pii.find_pii(df).collect():
        kind, n = LISTS[r.text]
        assert [s["kind"] for s in r.spans] == [kind] * n, r.text
    masked = [r.text for r in pii.mask_pii(df, length_col=None).collect()]
    for text, (kind, n) in zip(masked, LISTS.values()):
        assert text.count(f"<{kind.upper()}>") == n, text


def test_masking_leaves_no_base_span_and_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(i, t, 0, "x", 7) for i, t in enumerate(ODD)] + [(None, ODD[4], 0, None, None)], "doc_id long, text string, n_chars int, email_spans string, q int")
    out = pii.mask_pii(df)
    assert out.schema == df.schema and out.count() == df.count()
    for r in out.collect():
        assert base(r.text) == []
        assert r.n_chars == (None if r.text is None else len(r.text))
    by_id = {r.doc_id: r.text for r in out.collect()}
    assert by_id[ODD.index("call 555-123-4567")] == "call <LOCAL_PHONE>" and by_id[2] == "<EMAIL>"


#: Texts in which a masked match leaves a base match behind, and the masked text.
LEFT = {
    "+1 (826) 555-4081 190.137.223.204": "<PHONE> <IP>", "call +1 (826) 555-4081 190.137.223.204": "call <PHONE> <IP>",
    "DE89370400440532013000-4111111111111111": "<IBAN>-<CARD>", "ssn +12345678 123-45-6789": "ssn <PHONE> <SSN>",
    "call 212.555.0101.1.2.3.4": "call <LOCAL_PHONE>.<IP>", "+1 (826) 555-4081 190.137.223.204 " * 300: "<PHONE> <IP> " * 300,
}


def test_masking_goes_on_until_no_base_match_is_left(spark):
    random.seed(5)
    pool = [*LEFT, "+1 (826) 555-4081", "190.137.223.204", "212.555.0101", "4111111111111111", "call ", "ssn 123-45-6789", ".", " ", "-", "+", "300", "1"]
    texts = [*LEFT, *("".join(random.choice(pool[6:]) for _ in range(random.randint(2, 14))) for _ in range(400))]
    rows = pii.mask_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.text for r in sorted(rows)][: len(LEFT)] == list(LEFT.values())
    assert not [texts[r.doc_id] for r in rows if base(r.text)]


def test_extra_columns_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, "a@b.c", "s"), (1, "a@b.c", "s"), (None, None, None)], "doc_id long, text string, email_spans string")
    out = pii.find_pii(df)
    assert out.columns == ["doc_id", "text", "email_spans", "spans"] and out.count() == 3
    assert pii.find_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 31, 32, 33, 1000, 4097])
def test_running_total(spark, n):
    xs = [(i * 7) % 11 for i in range(n)]
    got = spark.createDataFrame([(xs,)], "x array<long>").select(running_total(F.col("x"))).first()[0]
    assert got == [sum(xs[: i + 1]) for i in range(n)] if n < 100 else got[-1] == sum(xs) and len(got) == n

"""Secrets against a plain Python reading of the contract."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import secrets

A = "".join
BASE = [
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]
LEAST = {"assign": 8, "access": 16, "hex": 32}


def base(text):
    out = []
    for i, (k, p) in enumerate(BASE):
        for m in p.finditer(text or ""):
            if len(m.group(1) if k == "assign" else m.group()) >= LEAST[k]:
                out.append((m.start(), i, k, m.end()))
    return sorted(out)


def digest(text):
    s = base(text)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
    return [sum(x[2] == k for x in s) for k, _ in BASE], hashlib.sha256(joined.encode()).hexdigest()


ODD = [
    None, "", "token=abc", "secret: token: abcdefghij", "Token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x", "API_KEY:'abcdefgh' apikey==12345678",
    "paſſword: longlonglong", "AKIA" + "A" * 11, "AKIA" + "B" * 12, "xAKIAAKIAAKIAAKIA1 ", "é🙂 " + "0123456789abcdef" * 2, "g" + "a" * 31 + "g" + "b" * 32, "F" * 40,
    "password" * 600, "token=" * 500, "a" * 5000, "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY-----", "token:" + " " * 2000 + "x" * 9,
]


def test_odd_texts_match_plain_python(spark):
    random.seed(5)
    pool = ["token", "SECRET", "passwd", "api", "_", "key", "=", ":", " ", "'", '"', "abc", "12345678", "AKIA", "X9", "é", "0f" * 9, "f0" * 17, "."]
    texts = ODD + [A(random.choice(pool) for _ in range(random.randint(0, 25))) for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in secrets.judge_secrets(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        got = [(s.start, s.listed, s.kind, s.end) for s in rows[i] if s.listed < 3]
        assert got == base(t), t
        assert [tuple(s)[:2] for s in rows[i]] == sorted(tuple(s)[:2] for s in rows[i])


def test_whole_table_matches_plain_python(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = secrets.op2_secrets(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, sha = digest(docs[r.doc_id].text)
        assert [r.n_assign, r.n_access, r.n_hex] == n and r.base_sha256 == sha


def test_ownership_separates_examples_from_live_values(spark):
    live, copied, fake = "q7R2mW9sK4xT8vB1", "Zk3N8pL5wQ2yH7cD", "changeme-example1"
    rows = [(1, f"token={live}", "a", "r1"), (2, f"secret: {live}", "a", "r2")] + [(10 + i, f"password={copied}", f"o{i}", "r") for i in range(3)]
    rows += [(10, f"password={copied}", "o0", "r"), (20, f"token={fake}", "z", None), (21, f"token={fake}", None, None), (None, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner_ string, found string")
    got = secrets.judge_secrets(df, owner=F.col("owner_"), repo=F.col("found")).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id] |= {(s.verdict, s.n_owners, s.n_repos) for s in r.spans}
    assert by[1] == by[2] == {("live", 1, 2)}
    assert by[10] == by[11] == by[12] == {("example", 3, 3)}
    assert by[20] == by[21] == {("unclear", 2, 2)} and by[None] == set()


def test_repositories_alone_make_an_example_and_values_count_whole(spark):
    late, wide = "g" * 400 + "Q7r2mW9sK4xT8vB1", "Yk3N8pL5wQ2zH7cD"
    rows = [(1, f"token={late}", "a", "r1")] + [(10 + i, f"secret={wide}", "a", f"r{i}") for i in range(secrets.EXAMPLE_REPOS)] + [(10, f"secret={wide}", "a", "r0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, o string, r string")
    got = {r.doc_id: [(s.verdict, s.n_owners, s.n_repos) for s in r.spans] for r in secrets.judge_secrets(df, owner=F.col("o"), repo=F.col("r")).collect()}
    assert got[1] == [("live", 1, 1)]  # distinct characters beyond the first 256 count
    assert got[10] == got[15] == [("example", 1, secrets.EXAMPLE_REPOS)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.judge_secrets(df).count() == 0

"""Quality rules: measurements against plain Python, ledger, policies, ablations."""

import random
import re

from quarry.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    inside = set()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in q.SYMBOLS for c in text), len(lines), len(lines) - len(set(lines)), len(inside), len(set(words)))


ODD = [None, "", " \t\n\x0b\x0c\r", "a", "a a a", "a a a a", "a b c a b c", "\x1ca\x85b\xa0c", "x\nx\n\nx \n x", "é🙂 é🙂 é🙂 é🙂", "#*$%&|<>", "a\r\na\r\na", "w " * 3000]


def test_measures_match_brute_force():
    random.seed(1)
    texts = ODD + ["".join(random.choice("ab \n\t#é") for _ in range(random.randint(0, 60))) for _ in range(800)]
    for t in texts:
        assert q.measure_text(t) == brute(t) if t is None or len(t) < 1000 else q.measure_text(t)[5] == 3000


def test_ledger_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, 1), (1, good, 1), (2, "short", 2), (3, good.replace("1", "###"), 3), (None, None, None), (4, "a b c " * 40, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, failed_bits int")
    led = q.ledger(df)
    assert led.count() == 6
    kept = [r.doc_id for r in q.apply_policy(led, q.STRICT).filter("kept").collect()]
    assert kept == [1, 1]
    abl = {(r.policy, r.rule): r for r in q.ablations(led, [q.BASE, q.STRICT]).collect()}
    assert abl["base", None].n_rejected == 3 and abl["v1", None].n_rejected == 4
    assert abl["v1", "symbols"].n_only == 1 and abl["v1", "symbols"].n_rejected_without == 3
    assert abl["base", "repeated_windows"].n_only == 1
    assert q.keep_good(df).columns == df.columns and q.keep_good(df).count() == 2
    assert q.ledger(df.limit(0)).count() == 0


def test_labelled_documents(spark, sf_dir):
    """Clean labelled documents of fifty words or more stay, labelled junk goes."""
    rows = q.op4_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) / len(clean) > 0.99 and sum(junk) / max(1, len(junk)) < 0.25

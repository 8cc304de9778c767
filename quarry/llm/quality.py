"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The *ledger* keeps the measurements and one
``failed_bits`` long whose bit ``i`` says that rule ``i`` failed. A *policy* is a versioned
bitmask with a verdict, applied to ledgers without reading a text again; *ablations* ask
what a policy would do without one of its rules, from the counts per distinct bitmask.

Defined results: a null or empty text has no words, measures zero everywhere and fails
``few_words``; repeated rows and null ids are measured row by row; an empty table gives an
empty ledger. Only the named text column is read, so further columns and their names do
not matter. Texts of any length are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common

SYMBOLS = "#*$%&|<>"
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words")])


@dataclass(frozen=True)
class Rule:
    """A name and a condition over the measurements that holds when the rule *fails*."""

    name: str
    fails: str


#: Bit ``i`` of a ledger is rule ``i``; append only, so stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "10 * word_chars < 25 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("few_distinct_words", "100 * n_distinct_words < 5 * n_words and n_words >= 200"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


def mask(names: Iterable[str]) -> int:
    """The bitmask of the named rules."""
    return sum(BIT[n] for n in dict.fromkeys(names))


@dataclass(frozen=True)
class Policy:
    """A document is rejected when more than ``tolerate`` of the policy's rules failed."""

    version: str
    rules: tuple[str, ...]
    tolerate: int = 0

    @property
    def mask(self) -> int:
        return mask(self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
#: The policy that the query and the pipeline apply.
STRICT = Policy("v1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "few_distinct_words"))


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split cuts at ASCII white space exactly
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), _in_repeats(at, len(ids)), len(ids)


def _in_repeats(ids: np.ndarray, size: int) -> int:
    """How many words stand in a three-word window that occurs twice or more. Exact: pairs
    are numbered before the third word is added, so a key stays below words * words."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= twice
    return int(np.count_nonzero(inside))


@F.arrow_udf(MEASURES)
def measures(texts: pa.Array) -> pa.Array:
    """The measurements of each text as a struct."""
    common.give_back()
    table = np.array([measure_text(t.as_py()) for t in texts], np.int64).reshape(len(texts), len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(MEASURES))], MEASURES.names)


def failed_bits(prefix: str = "") -> Column:
    """The bitmask of failed rules over measurement columns (``prefix`` like ``"q."``)."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        cond = r.fails
        for n in sorted(MEASURES.names, key=len, reverse=True):
            cond = _word_sub(cond, n, prefix + n)
        bits = bits.bitwiseOR(F.when(F.expr(cond), F.lit(BIT[r.name])).otherwise(F.lit(0)).cast("long"))
    return bits


def _word_sub(text: str, name: str, by: str) -> str:
    return " ".join(by if t == name else t for t in text.split(" "))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``failed_bits``."""
    common.bounded_batches(docs.sparkSession)
    q = docs.select(common.col(id_col).alias("id"), measures(common.col(text_col)).alias("q"))
    return q.select(F.col("id").alias(id_col), "q.*", failed_bits("q.").alias("failed_bits"))


def rejected(policy: Policy, bits: Column | str = "failed_bits") -> Column:
    """Whether a policy rejects a ledger row."""
    b = F.col(bits) if isinstance(bits, str) else bits
    return F.bit_count(b.bitwiseAND(F.lit(policy.mask).cast("long"))) > policy.tolerate


def apply_policy(rows: DataFrame, policy: Policy, verdict: str = "kept") -> DataFrame:
    """A ledger with the policy's verdict; no text is read."""
    return rows.withColumn(verdict, ~rejected(policy))


def ablations(rows: DataFrame, policies: Iterable[Policy]) -> DataFrame:
    """What each policy rejects, and what it would let go without each of its rules.

    The ledger is first counted by distinct bitmask (at most 2 ** rules rows, pre-aggregated
    in each task), so every policy and rule is answered from that table. Columns: policy,
    rule (null: the whole policy), n_failed (documents failing the rule or any rule),
    n_rejected, n_only (rejected only because of the rule), n_rejected_without.
    """
    counts = rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    asks = [(p.version, None, p.mask, p.mask, p.mask, p.tolerate) for p in policies]
    asks += [(p.version, r, BIT[r], p.mask, p.mask & ~BIT[r], p.tolerate) for p in policies for r in p.rules]
    names = ("policy", "rule", "own", "whole", "without", "tolerate")
    ask = F.array(*(F.struct(*(F.lit(v).cast("string" if i < 2 else "long").alias(c) for i, (c, v) in enumerate(zip(names, a)))) for a in asks))
    over = lambda m: F.bit_count(F.col("failed_bits").bitwiseAND(F.col(f"ask.{m}"))) > F.col("ask.tolerate")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        counts.select("failed_bits", "n", F.explode(ask).alias("ask")).groupBy("ask.policy", "ask.rule").agg(
            n(F.col("failed_bits").bitwiseAND(F.col("ask.own")) != 0)("n_failed"),
            n(over("whole"))("n_rejected"),
            n(over("whole") & ~over("without"))("n_only"),
            n(over("without"))("n_rejected_without"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = STRICT, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with exactly their columns."""
    common.bounded_batches(docs.sparkSession)
    q = common.free_name(docs, "q")
    held = docs.withColumn(q, measures(common.col(text_col)))
    return held.filter(~rejected(policy, failed_bits(f"{q}."))).select(*map(common.col, docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document with its base failure and the verdict of ``STRICT``."""
    rows = apply_policy(ledger(common.table(spark, sf_dir, "documents")), STRICT)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rejected(BASE).alias("base_failed"), "kept", "n_lines", "n_distinct_words", "failed_bits",
        F.lit(STRICT.version).alias("policy"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS s(k) WHERE c > 1 GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, len(list_distinct(ws))::BIGINT AS n_distinct_words
  FROM d JOIN w USING (rid) LEFT JOIN p USING (rid) LEFT JOIN ln USING (rid)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 10 * word_chars < 25 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_distinct_words < 5 * n_words AND n_words >= 200 THEN 64 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  failed_bits = 0 AS kept, n_lines, n_distinct_words, failed_bits, 'v1' AS policy
FROM b
"""

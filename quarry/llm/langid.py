"""Language identification as inference of a mixture.

Each language has a model of hashed three-byte grams, counted over all training documents.
A document is a mixture of languages: expectation-maximisation estimates its proportions
from its grams' likelihoods, and the language set grows as long as the penalised likelihood
does. The prediction is the language of largest proportion.

Training counts are summed in each task before they are shuffled. The model is sparse: per
bucket the languages that have it, at most ``BUCKETS`` pairs a language whatever the input. It
goes out with the function that predicts; its size is checked first, and a label column with
more pairs than ``MOST_PAIRS`` (thousands of languages) is refused, not cut. Prediction reads
the text alone, whole.

Defined results: a null text or one without a letter (Unicode category L) is ``und`` with score 0; so is every
text when nothing could be learned. Ties go to the name that sorts first. Training leaves
out rows without a language or an id; repeated rows count as often as they stand; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common

BUCKETS = 1 << 15
SMOOTH = 0.5
#: Cost of one more language in units of the logarithm of the number of grams.
PENALTY = 3.0
STEPS, TOLERANCE = 30, 1e-4
#: (bucket, language) pairs of a model that is sent to tasks: some 200 MB.
MOST_PAIRS = 1 << 24
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_KEEP = np.full(256, 0x20, np.uint32)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def grams(text: str | None) -> np.ndarray:
    """The hashed three-byte grams of a text in lower case; other characters than letters of
    any script count as blanks, and no gram has a blank in its middle."""
    b = _KEEP[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    if len(b) < 3:
        return np.empty(0, np.int64)
    g = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[b[1:-1] != 0x20]
    return (g * np.uint32(0x9E3779B1) >> np.uint32(17)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Languages in order; the probability each gives to a bucket it has not seen; and, bucket
    by bucket (``start``), the languages (``owner``) that have seen it, with its probability."""

    languages: tuple[str, ...]
    unseen: np.ndarray
    start: np.ndarray
    owner: np.ndarray
    seen: np.ndarray

    def likely(self, ids: np.ndarray) -> np.ndarray:
        """The probabilities of buckets, a row per language."""
        out = np.repeat(self.unseen[:, None], len(ids), axis=1)
        size = self.start[ids + 1] - self.start[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[self.owner[at], np.repeat(np.arange(len(ids)), size)] = self.seen[at]
        return out

    def proportions(self, likely: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
        """Maximum-likelihood proportions of the languages whose gram likelihoods are the rows
        of ``likely``, and the log-likelihood."""
        share = np.full(len(likely), 1.0 / len(likely))
        if len(likely) > 1:
            weight = count / count.sum()
            for _ in range(STEPS):
                new = share * (likely @ (weight / (share @ likely)))
                moved = np.abs(new - share).max()
                share = new
                if moved < TOLERANCE:
                    break
        return share, float(count @ np.log(share @ likely))

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """The chosen languages with their proportions, largest first; empty if undetermined."""
        if not self.languages or not text or not _LETTER.search(text):
            return []
        ids, count = np.unique(grams(text), return_counts=True)
        if not len(ids):
            return []
        likely, count = self.likely(ids), count.astype(float)
        alone = np.log(likely) @ count
        # candidates in the order of their share in the mixture of all languages
        every, _ = self.proportions(likely, count)
        chosen = [int(np.argmax(alone))]
        best, share = float(alone[chosen[0]]), np.ones(1)
        cost = PENALTY * np.log(count.sum() + 1)
        for c in np.argsort(-every, kind="stable").tolist():
            if c in chosen:
                continue
            more, score = self.proportions(likely[[*chosen, c]], count)
            if score - best <= cost:
                break
            chosen, best, share = [*chosen, c], score, more
        return sorted(((self.languages[c], float(s)) for c, s in zip(chosen, share)), key=lambda x: (-x[1], x[0]))


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, bucket, n)`` over all rows with a language; summed per task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                have = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                have += np.bincount(np.concatenate([grams(t) for t in texts]), minlength=BUCKETS)
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": have[at]})

    held = docs.select(common.col(lang_col).cast("string").alias("lang"), common.col(text_col).alias("text")).filter("lang is not null")
    each = held.mapInPandas(count, "lang string, bucket long, n long")
    return each.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of all rows of ``docs`` that have a language."""
    counts = common.saved(gram_counts(docs, lang_col, text_col))
    if counts.count() > MOST_PAIRS:
        raise ValueError(f"the languages have more than {MOST_PAIRS} grams between them")
    table = counts.toPandas()
    names, owner = np.unique(table["lang"].to_numpy(object).astype(str), return_inverse=True) if len(table) else (np.empty(0, str), np.empty(0, np.int64))
    bucket, n = table["bucket"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    total = np.bincount(owner, n, minlength=len(names)) + SMOOTH * BUCKETS
    order = np.lexsort((owner, bucket))
    start = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    return Model(tuple(names.tolist()), SMOOTH / total, start, owner[order], ((n + SMOOTH) / total[owner])[order])


def predict(text: Column, model: Model) -> Column:
    """Struct of lang_pred, score (its proportion) and languages (``lang:proportion`` of the
    chosen set, comma-joined)."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.StringType())]))
    def infer(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = model.mixture(t)
            top = found[0] if found else (UNKNOWN, 0.0)
            rows.append((top[0], min(1.0, top[1]), ",".join(f"{n}:{s:.3f}" for n, s in found)))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    return infer(text)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the three quarters that are not held out."""
    common.bounded_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs.filter((part != 2) & F.col("lang").isNotNull()))
    return docs.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")

"""Importance resampling towards a target text: hashed n-gram features, log-ratio weights,
Gumbel noise, a draw of the highest scores.

A batch of texts is joined with separator sentinels and lower-cased at once; one regex pass
over the joined bytes finds all words, document offsets looked up with ``searchsorted`` tell
whose they are, and n-grams that would reach over a sentinel are masked before the counts are
taken with ``bincount``. The matches are consumed in slices of bounded size that carry the last
words over, so a text of any length needs the memory of its bytes and of one slice.

Two passes read the texts: one counts the buckets of the table and of the target (a row per
bucket and task, added up), one scores the documents against the gains, a list as long as the
number of buckets. Ranks come from the counts of equal scores, so no task orders all rows.

Defined results: a null or empty text has no features, weight 0 and too few words to be
drawn; a null id is hashed as empty text and stands before all ids in ties; repeated rows
count and are ranked one by one; an empty table gives an empty result and an empty target
counts as no features; of a table's columns only id and text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import batched, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

#: Words over the UTF-8 bytes of a text lower-cased in A-Z: digits, letters, all beyond ASCII.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: No part of a word; stands between the texts of a batch.
SENTINEL = b"\n"
NGRAMS, BUCKETS = 2, 10_000
SEED, PERCENT, LEAST_WORDS = 7, 25, 20
#: Matches held at a time, and bytes of texts joined at a time.
SLICE, TOGETHER = 1 << 16, 1 << 20
#: Scores that share a block: the offsets of ranks are added up block by block.
_BLOCK = 256


def batch_features(texts: list[bytes], ngrams: int = NGRAMS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Slice by slice of a batch: the document number of each word, and for each length of
    n-gram the (document number, bucket) of the n-grams that end in the slice."""
    joined = SENTINEL.join(texts).lower()  # bytes.lower knows A-Z only
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(SENTINEL)
    begins = np.cumsum(sizes) - sizes
    words: list[bytes] = []
    owner = np.empty(0, np.int64)
    for matches in batched(WORDS.finditer(joined), SLICE):
        carried = len(words)
        words += map(re.Match.group, matches)
        starts = np.fromiter(map(re.Match.start, matches), np.int64, len(matches))
        owner = np.concatenate((owner, np.searchsorted(begins, starts, side="right") - 1))
        hashes: list[int] = list(map(crc32, words))
        grams = []
        for n in range(1, ngrams + 1):
            if n > 1:  # the n-gram goes on where the shorter one ended
                hashes = list(map(crc32, words[n - 1 :], map(crc32, repeat(b" "), hashes)))
            ends = np.arange(n - 1, len(words))
            whole = (ends >= carried) & (owner[ends] == owner[ends - (n - 1)])
            hashed = np.fromiter(hashes, np.int64, len(hashes))
            grams.append((owner[ends][whole], hashed[whole] % buckets))
        yield owner[carried:], grams
        keep = max(len(words) - (ngrams - 1), 0)
        words, owner = words[keep:], owner[keep:]


def bucket_counts(texts: list[bytes], ngrams: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a batch fall into each bucket."""
    out = np.zeros(buckets, np.int64)
    for _, grams in batch_features(texts, ngrams, buckets):
        for _, bucket in grams:
            out += np.bincount(bucket, minlength=buckets)
    return out


def batch_weights(texts: list[bytes], gains: np.ndarray, ngrams: int = NGRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text of a batch: words, features, and the floored mean gain of its features."""
    n_words, n_features, total = (np.zeros(len(texts), np.int64) for _ in range(3))
    for owner, grams in batch_features(texts, ngrams, len(gains)):
        n_words += np.bincount(owner, minlength=len(texts))
        for doc, bucket in grams:
            n_features += np.bincount(doc, minlength=len(texts))
            np.add.at(total, doc, gains[bucket])
    return n_words, n_features, np.floor_divide(total, np.maximum(n_features, 1))


def gains(source: list[int], target: list[int]) -> list[int]:
    """Of each bucket: 1000 times the log ratio of its smoothed shares, floored."""
    b, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source, target)]


def _joined(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of Arrow batches with their texts as bytes, some ``TOGETHER`` bytes at a time."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= TOGETHER or i + 1 == len(texts):
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def count_buckets(texts: DataFrame, text_col: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS) -> list[int]:
    """The features of a whole table by bucket; a list of ``buckets`` numbers on the driver."""
    common.bounded_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, some in _joined(batches, 0):
            total += bucket_counts(some, ngrams, buckets)
        common.give_back(1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    counted = texts.select(common.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = [0] * buckets
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the hash of ``seed:id``, floored."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def score_documents(
    docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", ngrams: int = NGRAMS, seed: int = SEED
) -> DataFrame:
    """Per document: id, n_words, n_features, weight, score (weight plus noise)."""
    common.bounded_batches(docs.sparkSession)
    table = np.array(gain, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in _joined(batches, 1):
            numbers = [pa.array(x, pa.int64()) for x in batch_weights(some, table, ngrams)]
            common.give_back()
            yield pa.RecordBatch.from_arrays([part.column(0), *numbers], ["id", "n_words", "n_features", "weight"])

    read = docs.select(common.col(id_col).alias("id"), common.col(text_col).cast("string").alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    weighed = read.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The scored table with ``rank``: 1, 2, 3... for the ``floor(percent * N / 100)`` highest
    scores of the N documents with enough words, ties to the smaller id; else null.

    Scores are whole numbers between the sums of the least and greatest gain and noise, some
    100,000 values whatever the input, so how many rows have each one is a small table. It
    gives the rank at which each score begins and the score at which the draw ends; only rows
    down to that score are numbered, each within its score.
    """
    able = F.col("n_words") >= least_words
    counted = scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / _BLOCK))
    counted = common.saved(counted)
    blocks = counted.groupBy("block").agg(F.sum("n").alias("n")).orderBy(F.col("block").desc()).collect()
    total = sum(r.n for r in blocks)
    wanted = percent * total // 100
    begins, at = [], 0
    for r in blocks:
        begins.append((r.block, at))
        at += r.n
    spark = scored.sparkSession
    earlier = Window.partitionBy("block").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.join(F.broadcast(spark.createDataFrame(begins, "block long, above_block long")), "block")
        .withColumn("above", F.col("above_block") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .filter(F.col("above") < wanted)
        .select("score", "above")
    )
    within = Window.partitionBy("score").orderBy("id", "n_features", "weight")
    marked = scored.join(F.broadcast(offsets), "score", "left")
    inside = able & F.col("above").isNotNull()
    drawn = marked.filter(inside).withColumn("rank", F.col("above") + F.row_number().over(within))
    rest = marked.filter(~inside).withColumn("rank", F.lit(None).cast("long"))
    out = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).unionByName(rest)
    return out.select("id", "n_words", "n_features", "weight", "score", "rank")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Every document's id, n_features, weight, score and rank in the draw towards ``target``."""
    gain = gains(count_buckets(docs, text_col, ngrams, buckets), count_buckets(target, target_col, ngrams, buckets))
    scored = common.saved(score_documents(docs, gain, id_col, text_col, ngrams, seed))
    ranked = draw(scored, percent, least_words)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the texts of ``benchmark``."""
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def _ground(words: str) -> str:
    return f"list_concat({words}, list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_ASCII[0]}', '{_ASCII[1]}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The checksum is folded over the bytes of each distinct feature by its table of 256 entries.
ORACLE = f"""
WITH steps AS MATERIALIZED (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT range::BIGINT AS b FROM range(256))
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, w, {_ground("w")} AS f FROM (SELECT doc_id, {_SQL_WORDS} AS w FROM documents)
), goal AS MATERIALIZED (
  SELECT {_ground("w")} AS f FROM (SELECT {_SQL_WORDS} AS w FROM benchmark)
), source_features AS MATERIALIZED (SELECT row_id, unnest(f) AS feature FROM docs
), features AS MATERIALIZED (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM source_features UNION SELECT unnest(f) FROM goal)
), hashed AS MATERIALIZED (
  SELECT feature, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
                      lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM features, steps
), s AS (SELECT bucket, count(*) AS n FROM source_features JOIN hashed USING (feature) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(f) AS feature FROM goal) JOIN hashed USING (feature) GROUP BY bucket
), totals AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) AS s_all, (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) AS t_all
), gains AS MATERIALIZED (
  SELECT range AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain
  FROM range({BUCKETS}) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range, totals
), weights AS (
  SELECT row_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM source_features JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY row_id
), scored AS (
  SELECT doc_id, len(f)::BIGINT AS n_features, len(w) AS n_words, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (row_id)
), ranked AS (
  SELECT *, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place,
         count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM ranked
"""

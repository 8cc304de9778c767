"""Vector code compression: product codes whose nearest entries Orchard's search finds.

Components become whole numbers and vectors are cut into equal consecutive parts. Each part
position has a codebook; rounds assign every part to its nearest entry and move each entry to
the floored mean of its parts. Orchard's search keeps, for every entry, the list of all entries
by distance from it. A part starts at some entry and goes along that entry's list; at an entry
that is nearer to it, it jumps to that entry's list; visited entries are marked and not measured
again; once the list is beyond twice the current distance, the triangle inequality says that
nothing nearer is left. Distances are squared whole numbers, so "twice" is a factor of four and
ties, which that bound still includes, go to the lower index exactly.

Codebooks are small whatever the input (``entries`` times the dimension), so they travel with
the tasks. A round is one scan of the vectors; each task adds up its own parts and gives a row
per entry it used, and Spark adds those up.

Defined results: rows whose vector is null or holds null or non-finite components are left
out, and so are those with a component of 65,536 or more either way, whose squared distances
would not fit a long; a vector shorter than the longest, or than a multiple of the number of parts, counts as
filled up with zeros; rows that repeat an id are rows of their own, and in the choice of the
first entries they are ordered by their components, null ids last; with fewer rows than entries
the codebooks are that much smaller; an empty table gives an empty result; of other columns
only id, vector and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components from here on either way do not take part.
LIMIT = 1 << 16
#: Entries of a list looked at together, and parts searched together.
STRETCH, TOGETHER = 8, 4096
#: Label totals up to so many rows are broadcast; more are joined by shuffle, with the same rows.
BROADCAST_LABELS = 100_000


class Codebook:
    """The entries of one part position, each with its list of entries by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norm = (entries * entries).sum(axis=1)
        away = norm[:, None] + norm[None, :] - 2 * (entries @ entries.T)
        self.lists = np.argsort(away, axis=1, kind="stable")
        self.away = np.take_along_axis(away, self.lists, axis=1)
        sums = entries.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]
        self.measured = 0

    def _start(self, parts: np.ndarray) -> np.ndarray:
        """Where the search begins: an entry of about the same sum."""
        place = np.searchsorted(self.sums, parts.sum(axis=1))
        return self.by_sum[np.minimum(place, len(self.sums) - 1)]

    def _distance(self, parts: np.ndarray, which: np.ndarray) -> np.ndarray:
        self.measured += len(which)
        diff = parts - self.entries[which]
        return np.einsum("ij,ij->i", diff, diff)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's nearest entry, ties to the lower index, and its squared distance."""
        found = [self._together(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2

    def _together(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.entries)
        at = np.zeros(len(parts), np.int64)  # how far each part is along its entry's list
        active = np.arange(len(parts))
        best = self._start(parts)
        dist = self._distance(parts, best)
        visited = np.zeros((len(parts), k), bool)
        visited[active, best] = True
        while len(active):
            here = best[active]
            ahead = at[active, None] + np.arange(STRETCH)
            listed = ahead < k
            ahead = np.minimum(ahead, k - 1)
            entry = self.lists[here[:, None], ahead]
            reach = listed & (self.away[here[:, None], ahead] <= 4 * dist[active, None])
            row, place = np.nonzero(reach & ~visited[active[:, None], entry])
            at[active] += STRETCH
            moved = np.zeros(len(active), bool)
            if len(row):
                seen, part = entry[row, place], active[row]
                visited[part, seen] = True
                measured = self._distance(parts[part], seen)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                least = np.minimum.reduceat(measured, first)
                tied = measured == np.repeat(least, np.diff(first, append=len(row)))
                lowest = np.minimum.reduceat(np.where(tied, seen, k), first)
                of = row[first]
                part = active[of]
                better = (least < dist[part]) | ((least == dist[part]) & (lowest < best[part]))
                part = part[better]
                best[part], dist[part], at[part] = lowest[better], least[better], 0
                moved[of[better]] = True
            active = active[moved | reach[:, -1]]
        return best, dist


@dataclass
class Codebooks:
    """The codebooks of all part positions: ``entries[part][entry]`` is a list of components."""

    entries: list[list[list[int]]]

    @property
    def width(self) -> int:
        return len(self.entries[0][0])

    def searchers(self) -> list[Codebook]:
        return [Codebook(np.array(e, np.int64)) for e in self.entries]

    def sha256(self) -> str:
        """Digest of all components by part, entry and position, as decimals."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and each component a number within ``LIMIT``."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LIMIT)), F.lit(False))


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label and whole-number components (v) of the usable rows."""
    vector = common.col(vector_col)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return rows.filter(usable(vector)).select(common.col(id_col).alias("id"), common.col(label_col).alias("label"), whole.alias("v"))


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of ``dim`` numbers, short ones filled up."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    if (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(vectors), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def _codes(books: list[Codebook], matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By part position: the parts, their nearest entries and squared distances."""
    width = matrix.shape[1] // len(books)
    for p, book in enumerate(books):
        parts = np.ascontiguousarray(matrix[:, p * width : (p + 1) * width])
        yield parts, *book.nearest(parts)


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the rows of smallest id; none for an empty table."""
    seeds = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not seeds:
        return None
    dim = vectors.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-dim // parts))
    filled = [list(s.v) + [0] * (width * parts - len(s.v)) for s in seeds]
    return Codebooks([[f[p * width : (p + 1) * width] for f in filled] for p in range(parts)])


def moved_books(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """A round: every entry at the floored mean of the parts assigned to it."""
    parts, k, width = len(books.entries), len(books.entries[0]), books.width

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = books.searchers()
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for p, (part, nearest, _) in enumerate(_codes(search, _matrix(batch.column(0), parts * width))):
                count[p] += np.bincount(nearest, minlength=k)
                np.add.at(total[p], nearest, part)
        p, e = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(total[p, e].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), sums], ["part", "entry", "n", "total"])

    tallied = vectors.select("v").mapInArrow(tally, "part int, entry int, n long, total array<long>")
    cells = tallied.select("part", "entry", "n", F.posexplode("total").alias("at", "total"))
    new = [[list(entry) for entry in part] for part in books.entries]
    for r in cells.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        new[r.part][r.entry][r["at"]] = r.total // r.n
    return Codebooks(new)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over all prepared vectors."""
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved_books(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Per prepared row: id, label, code (an entry index per part), error (squared distances
    to the entries, added up)."""
    parts, width = len(books.entries), books.width

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = books.searchers()
        for batch in batches:
            found = [(near, dist) for _, near, dist in _codes(search, _matrix(batch.column(2), parts * width))]
            near = np.column_stack([f[0] for f in found])
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * parts, pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(sum(f[1] for f in found), pa.int64())], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("id", "label", "v").mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long")


def decode(code: Column, books: Codebooks) -> Column:
    """The vector that a code stands for: the entries' components, back on their scale."""
    pieces = [F.lit([[x / SCALE for x in e] for e in part]) for part in books.entries]
    return F.concat(*(F.element_at(piece, code[p] + 1) for p, piece in enumerate(pieces)))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """``encode`` over a whole table with label_error, the error added up over equal labels
    (nulls together), and the codebooks."""
    vectors = prepared(rows, id_col, vector_col, label_col)
    books = train(vectors)
    if books is None:
        return vectors.select("id", "label", F.lit(None).cast("array<int>").alias("code"), *(F.lit(None).cast("long").alias(c) for c in ("error", "label_error"))), None
    coded = common.saved(encode(vectors, books))
    totals = common.saved(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    if totals.count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all embeddings."""
    coded, books = compress(common.table(spark, sf_dir, "embeddings"))
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    digest = books.sha256() if books else None
    return coded.select(F.col("id").alias("vec_id"), F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def _sql_round(i: int) -> str:
    """The codebooks after one more round."""
    return f"""
near_{i} AS MATERIALIZED (
  SELECT r, p, min(row(list_sum(list_transform(list_zip(parts.x, book_{i}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry)) AS best
  FROM parts JOIN book_{i} USING (p) GROUP BY r, p
), book_{i + 1} AS MATERIALIZED (
  SELECT p, entry, coalesce(moved.x, book_{i}.x) AS x FROM book_{i} LEFT JOIN (
    SELECT p, entry, list(floor(total::DOUBLE / n)::BIGINT ORDER BY pos) AS x FROM (
      SELECT p, best[2] AS entry, pos, sum(x[pos]) AS total, count(*) AS n FROM parts JOIN near_{i} USING (r, p), (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM kept))) AS pos)
      WHERE pos <= len(x) GROUP BY ALL) GROUP BY ALL) moved USING (p, entry)
),"""


#: The same rounds with all distances measured.
ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p)
), book_0 AS MATERIALIZED (SELECT p, r - 1 AS entry, x FROM parts WHERE r <= {ENTRIES}
),{"".join(map(_sql_round, range(ROUNDS)))}
final AS MATERIALIZED (
  SELECT r, p, min(row(list_sum(list_transform(list_zip(parts.x, book_{ROUNDS}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry)) AS best
  FROM parts JOIN book_{ROUNDS} USING (p) GROUP BY r, p
), coded AS MATERIALIZED (
  SELECT vec_id, label, string_agg(format('{{:02x}}', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM kept JOIN final USING (r) GROUP BY r, vec_id, label
), books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book_{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""

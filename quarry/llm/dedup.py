"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set is its distinct five-word shingles. Documents with equal sets form a class,
found by aggregation alone. Each class has a sketch of 128 coordinates; 32 bands of four
coordinates propose candidates (a pair at similarity 0.75 shares no band with probability
5e-6), and a link stands only when the full sets confirm it. Links are closed into
components without ever listing the pairs of a group:

1. every member of a band bucket is compared with the bucket's least member only; the
   minimum is pre-aggregated and joined back, so a hot bucket is a skewed join;
2. classes connected by buckets form a family, and those verified against one hub a group
   within it. Where a family has several groups, its classes are dealt into blocks of bounded bytes by set
   size, and pairs of blocks whose sizes allow a link compare their members across groups,
   inside the task, by sketch first and full set next. Only links that join groups come out.

Between sketch and set, a pair is dismissed when fewer than 64 of 128 coordinates agree: at
similarity 0.75 the count is 96 on average, concentrated as by sampling without
replacement, and falls below 64 with probability under 1e-9.

Defined results: without words or text a document has an empty set and is linked with
nothing; a row without an id is linked with nothing and kept, its component null; rows that
share an id are one document, linked by the links of each; an empty table gives an empty
result; only the id and text columns are read. Whole texts are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common, shingles
from quarry.llm.graph import components

COORDINATES, BAND_ROWS = 128, 4
AGREE = 64
#: Numerator and denominator of the least similarity of a link.
SIMILAR = (75, 100)
#: A block of a family holds at most about so many members and so many bytes of sets.
BLOCK_MEMBERS, BLOCK_BYTES = 1024, 16 << 20
#: Ids beyond this number are joined by shuffle, fewer are broadcast (8 MB).
BROADCAST_IDS = 1_000_000


_LONG, _BINARY = T.LongType(), T.BinaryType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


@F.arrow_udf(_fields(n=_LONG, f1=_LONG, f2=_LONG, bands=T.ArrayType(_LONG)))
def _signature(texts: pa.Array) -> pa.Array:
    """Set size, a 128-bit fingerprint of the set, and its band keys."""
    common.give_back()
    numbers, bands, ends = [], [np.empty(0, np.int64)], [0]
    for t in texts:
        s = shingles.shingle_set(t.as_py())
        keys = shingles.band_keys(shingles.fast_sketch(s, COORDINATES), BAND_ROWS).view(np.int64) if len(s) else bands[0]
        prints = (int(shingles.mix(s ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2))
        numbers.append((len(s), *prints))
        bands.append(keys)
        ends.append(ends[-1] + len(keys))
    table = np.array(numbers, np.int64).reshape(len(texts), 3)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands)))
    return pa.StructArray.from_arrays([*(pa.array(table[:, i]) for i in range(3)), lists], ["n", "f1", "f2", "bands"])


@F.arrow_udf(_fields(n=_LONG, sketch=_BINARY, items=_BINARY))
def _full_set(texts: pa.Array) -> pa.Array:
    """The set itself, sorted, and its sketch cut to 16 bits a coordinate."""
    common.give_back()
    sets = [shingles.shingle_set(t.as_py()) for t in texts]
    sketches = [shingles.fast_sketch(s, COORDINATES).astype(np.uint16).tobytes() for s in sets]
    columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
    return pa.StructArray.from_arrays(columns, ["n", "sketch", "items"])


@F.arrow_udf(T.IntegerType())
def _agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), COORDINATES) for c in (a, b))
    return pa.array((x == y).sum(axis=1), pa.int32())


@F.arrow_udf(T.BooleanType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(a, b)], pa.bool_())


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = shingles.overlap(a, b)
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _sizes_allow(n, m):
    return (SIMILAR[1] * F.least(n, m)) >= (SIMILAR[0] * F.greatest(n, m))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Per row: id, n, v (the least id of its class); per class: v and its band keys."""
    rows = common.saved(docs.select(common.col(id_col).alias("id"), _signature(common.col(text_col)).alias("s")).select("id", "s.*"))
    known = rows.filter("id is not null and n > 0")
    classes = common.saved(known.groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "bands")).alias("c")).select("n", "f1", "f2", F.col("c.id").alias("v"), "c.bands"))
    ids = rows.drop("bands").join(classes.drop("bands"), ["n", "f1", "f2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("v")).alias("v"))
    return common.saved(ids), classes.select("v", "bands")


def _bucket_stars(classes: DataFrame) -> DataFrame:
    """(v, hub): each class with the least class of every bucket it shares."""
    bands = classes.select("v", F.explode("bands").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("v").alias("hub"), F.max("v").alias("top")).filter("hub < top").select("key", "hub")
    return common.saved(bands.join(hubs, "key").filter("v <> hub").select("v", "hub").distinct())


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """v, n, sketch, items of the named classes, from their documents' whole texts. An id that
    stands for several texts gives a row for each."""
    wanted = nodes.select(F.col("node").alias("v"))
    if nodes.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    held = docs.select(common.col(id_col).alias("v"), common.col(text_col).alias("t")).join(wanted, "v", "left_semi")
    # filtered only after the checkpoint: a filter on the function's result would otherwise
    # move below the join, and the function with it to every document
    return common.saved(held.select("v", _full_set(F.col("t")).alias("s")).select("v", "s.*")).filter("n > 0")


def _star_links(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """The stars' edges that the sketches leave and the full sets confirm, as (a, b)."""
    light = sets.select("v", "n", "sketch")
    hub = lambda df: df.select(*(F.col(c).alias({"v": "hub"}.get(c, f"hub_{c}")) for c in df.columns))
    near = stars.join(light, "v").join(hub(light), "hub").filter(_sizes_allow(F.col("n"), F.col("hub_n")))
    near = common.saved(near.filter(_agreement("sketch", "hub_sketch") >= AGREE).select("v", "hub").distinct())
    full = sets.select("v", "items")
    return near.join(full, "v").join(hub(full), "hub").filter(_similar("items", "hub_items")).select(F.col("v").alias("a"), F.col("hub").alias("b"))


def _family_links(families: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across the groups that are left within a family, as (a, b)."""
    # a group by first links alone, not closed: classes of one group are linked, and those of
    # one component in different groups are joined in the tasks
    groups = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("grp"))
    held = families.join(groups, "node", "left").select("node", F.col("component").alias("family"), F.coalesce("grp", "node").alias("grp"))
    # a family of two was settled by its star; one of a single group needs nothing more
    open_ = held.groupBy("family").agg(F.count("*").alias("n"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("n > 2 and lo < hi").select("family")
    # sizes of linked sets differ by at most 4/3, so by at most one level
    members = common.saved(
        held.join(open_, "family").withColumnRenamed("node", "v").join(sets, "v")
        .withColumn("level", F.floor(F.log("n") / F.log(F.lit(1.34))).cast("int"))
    )
    sized = members.groupBy("family", "level").agg(F.count("*").alias("k"), F.sum(F.col("n") * 8 + 256).alias("b"))
    parts = sized.select("family", "level", F.greatest(F.ceil(F.col("k") / BLOCK_MEMBERS), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int").alias("parts"))
    dealt = members.join(parts, ["family", "level"]).withColumn("part", F.pmod(F.hash("v"), F.col("parts"))).drop("parts")
    blocks = parts.select("family", "level", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = blocks.select("family", F.col("level").alias("level2"), F.col("part").alias("part2"))
    pairs = blocks.join(other, "family").filter("(level = level2 and part <= part2) or level2 = level + 1")
    task = F.xxhash64("family", "level", "part", "level2", "part2").alias("task")
    sides = pairs.select(task, "family", F.explode(F.when(
        (F.col("level") == F.col("level2")) & (F.col("part") == F.col("part2")), F.array(F.struct("level", "part", F.lit(0).alias("side")))
    ).otherwise(F.array(F.struct("level", "part", F.lit(0).alias("side")), F.struct(F.col("level2").alias("level"), F.col("part2").alias("part"), F.lit(1).alias("side"))))).alias("s")).select("task", "family", "s.*")
    spread = dealt.join(sides, ["family", "level", "part"]).select("task", "side", "v", "grp", "n", "sketch", "items")
    return spread.groupBy("task").applyInArrow(_compare_blocks, "a long, b long")


def _compare_blocks(rows: pa.Table) -> pa.Table:
    """The links between members of different groups, of one block or across two, that join
    groups not joined yet in this task."""
    rows = rows.sort_by([("side", "ascending"), ("v", "ascending")])
    grp, v, n = rows["grp"].to_pylist(), rows["v"].to_numpy(), rows["n"].to_numpy()
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(len(rows), COORDINATES)
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["items"]]
    right = int(np.count_nonzero(rows["side"].to_numpy() == 0))
    one = right == len(rows)
    names = {g: i for i, g in enumerate(dict.fromkeys(grp))}
    mine = np.array([names[g] for g in grp])
    members: dict[int, list[int]] = {}
    for i, g in enumerate(mine.tolist()):
        members.setdefault(g, []).append(i)
    out = []
    for i in range(right):
        if len(members) == 1:
            break
        lo = i + 1 if one else right
        agree = (sketch[lo:] == sketch[i]).sum(axis=1)
        may = (agree >= AGREE) & (mine[lo:] != mine[i]) & (SIMILAR[1] * np.minimum(n[lo:], n[i]) >= SIMILAR[0] * np.maximum(n[lo:], n[i]))
        where = np.flatnonzero(may)
        for j in (where[np.argsort(-agree[where], kind="stable")] + lo).tolist():
            if mine[j] != mine[i] and _linked(sets[i], sets[j]):
                out.append((v[i], v[j]))
                gone, left = sorted((int(mine[i]), int(mine[j])), key=lambda g: len(members[g]))
                mine[members[gone]] = left
                members[left] += members.pop(gone)
    found = np.array(out, np.int64).reshape(len(out), 2)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable over links), kept."""
    common.bounded_batches(docs.sparkSession)
    ids, classes = _classes(docs, id_col, text_col)
    stars = _bucket_stars(classes)
    families = common.saved(components(stars.withColumnsRenamed({"v": "a", "hub": "b"})))
    sets = _sets(docs, families, id_col, text_col)
    first = common.saved(_star_links(stars, sets))
    more = _family_links(families, first, sets)
    # rows that share an id are one document
    shared = ids.filter("v is not null").groupBy("id").agg(F.min("v").alias("b"), F.max("v").alias("hi")).filter("b < hi").select("id", "b")
    same = ids.join(shared, "id").select(F.col("v").alias("a"), "b")
    whole = components(first.unionByName(more).unionByName(same)).select(F.col("node").alias("v"), "component")
    out = ids.join(whole, "v", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "v", "id").alias("component_id")
    )
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with exactly its columns: the one of least id, and of rows
    that repeat this id the one whose text hashes least. Rows without an id stay."""
    names, keep, place = docs.columns, common.free_name(docs, "keep_id"), common.free_name(docs, "place")
    kept = near_duplicates(docs, id_col, text_col).filter(F.col("kept") & common.col(id_col).isNotNull()).select(common.col(id_col).alias(keep)).distinct()
    once = docs.join(kept, common.col(id_col) == F.col(keep), "left_semi").withColumn(
        place, F.row_number().over(Window.partitionBy(common.col(id_col)).orderBy(F.xxhash64(common.col(text_col))))
    )
    return once.filter(F.col(place) == 1).select(*map(common.col, names)).unionByName(docs.filter(common.col(id_col).isNull()))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS (SELECT rid, md5(unnest(g)) AS h FROM s),
i AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.rid < b.rid GROUP BY ALL),
e AS (SELECT p.doc_id AS a, q.doc_id AS b FROM i JOIN s p ON p.rid = i.a JOIN s q ON q.rid = i.b WHERE 100 * n >= 75 * (len(p.g) + len(q.g) - n)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS n, a AS m FROM sym UNION SELECT sym.b, reach.m FROM reach JOIN sym ON sym.a = reach.n),
c AS (SELECT n, min(m) AS g FROM reach GROUP BY n)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(c.g, s.doc_id) AS component_id, s.doc_id = coalesce(c.g, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.n = s.doc_id
"""

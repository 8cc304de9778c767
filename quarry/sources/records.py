"""Records of delimited files that split: quoted line breaks, line numbers, headers by file.

A file is read as physical lines by any number of tasks. Whether a line begins inside a quoted
field depends on all lines before it, but what a line does to that state is one of four things:
it keeps it, flips it, or ends outside or inside whatever it was. Those compose, so

1. every split is walked once, in order, under both assumptions about its start. Only numbers
   and flags go through that step (an Arrow function that carries them from batch to batch);
   the text stays in Spark;
2. a row per split comes of it: its lines, its records, its effect on the state, its first line.
   A prefix over the splits of each file says how each split really begins, and how many lines
   and records stand before it. Where no line ends inside a quoted field every line is a record,
   and the same row comes of counts, without the walk;
3. that small table, joined back, gives every line its number in the file, its record's number
   in the file and whether it is a record by itself. Only lines of longer records are shuffled,
   to be put together by (file, record).

The first non-blank line of each file is its header.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ensure_checkpoint_dir

#: Split tables up to so many rows are broadcast to the lines; larger ones are joined by shuffle.
BROADCAST_SPLITS = 50_000
#: Bytes that a record over several lines may have; the lines of a longer one (a quote that
#: never closes swallows all that follows) are rejected one by one.
MOST_RECORD_BYTES = 64 << 20
_BYTES = "ISO-8859-1"
_ONE_BYTE = {"latin-1", "latin1", "iso-8859-1", "iso8859-1", "cp1252", "windows-1252"}
_INSIDE = r'^[^"]*+(?:""[^"]*+)*+"'


def is_utf16(encoding: str | None) -> bool:
    return (encoding or "").lower().replace("-", "") in ("utf16", "utf16le", "utf16be")


def decoded(raw: Column, encoding: str | None) -> Column:
    """Text from the bytes of a line: UTF-8, and what is not valid there as ISO-8859-1."""
    one_byte = F.decode(raw.cast("binary"), _BYTES)
    encoding = (encoding or "auto").lower()
    if encoding in _ONE_BYTE:
        return one_byte
    return raw if encoding in ("utf-8", "utf8") else F.when(F.is_valid_utf8(raw), raw).otherwise(one_byte)


def physical_lines(spark: SparkSession, files: list[str], encoding: str | None) -> DataFrame:
    """Every line in the order of its file: file, block (where its split begins), value, odd (its
    bytes are not UTF-8). Lines end at a line feed; a carriage return before it is still there."""
    if is_utf16(encoding):
        # its bytes cannot be split at line feeds: each file is decoded whole, in one task
        whole = spark.read.format("binaryFile").load(files).select(F.col("path").alias("file"), F.decode("content", "UTF-16").alias("text"))
        parts = F.split(F.regexp_replace("text", "\n\\z", ""), "\n")
        return whole.select("file", F.lit(0).cast("long").alias("block"), F.explode(parts).alias("value")).withColumn("odd", F.lit(False))
    lines = spark.read.option("lineSep", "\n").text(files)
    raw = F.col("value")
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), decoded(raw, encoding).alias("value"), (~F.is_valid_utf8(raw)).alias("odd"))


def _class(sep: str) -> tuple[str, str]:
    d = re.escape(sep)
    return d, f"[^{d}]"


def bare(text: Column, sep: str) -> Column:
    """A text that begins at the start of a field without its quoted fields. A quote opens a
    field at the field's start only, and what stands between a closing quote and the next
    separator belongs to the field."""
    d, other = _class(sep)
    return F.when(F.instr(text, '"') > 0, F.regexp_replace(text, rf'(^|{d})"[^"]*+(?:""[^"]*+)*+"{other}*+', "$1")).otherwise(text)


def opens(text: Column, sep: str) -> Column:
    """Whether a quoted field is open at the end of a text that begins at a field's start."""
    d, _ = _class(sep)
    return (F.instr(text, '"') > 0) & bare(text, sep).rlike(rf'(^|{d})"')


def stays_inside(text: Column, sep: str) -> Column:
    """The same for a text that begins inside a quoted field."""
    _, other = _class(sep)
    rest = F.regexp_replace(text, _INSIDE + other + "*+", "")
    return ~text.rlike(_INSIDE) | opens(rest, sep)


_PLACES = ("line", "record0", "record1", "run0", "run1")
_FLAGS = ("inside0", "inside1", "after0", "after1", "first")


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in _PLACES] + [T.StructField(n, T.BooleanType()) for n in _FLAGS]))
def _walk(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The lines of each split in order: place, state before and after, records begun so far and
    bytes since the last one began, each for a split that begins outside (0) and inside (1) a
    quoted field; and which line is the first that is not blank."""
    split, held = None, {}

    for columns in batches:
        splits, open0, open1, blank, size = (c.to_numpy(zero_copy_only=False) for c in columns)
        n = len(splits)
        out = {k: np.zeros(n, np.int64) for k in _PLACES} | {k: np.zeros(n, bool) for k in _FLAGS}
        edges = np.flatnonzero(np.concatenate(([True], splits[1:] != splits[:-1]))) if n else []
        for begin, end in zip(edges, [*edges[1:], n]):
            if splits[begin] != split:
                split, held = splits[begin], {"lines": 0, "found": False, "state": [False, True], "records": [0, 0], "run": [0, 0]}
            at = slice(begin, end)
            place = np.arange(end - begin)
            out["line"][at] = held["lines"] + place
            held["lines"] += end - begin
            text = ~blank[at]
            if not held["found"] and text.any():
                out["first"][begin + int(text.argmax())] = held["found"] = True
            a, b = open0[at], open1[at]
            settled = np.maximum.accumulate(np.where(a == b, place, -1))
            flips = np.cumsum(a & ~b)
            turned = (flips - np.where(settled >= 0, flips[settled], 0)) % 2 == 1
            for k in (0, 1):
                after = np.where(settled >= 0, a[settled], held["state"][k]) ^ turned
                inside = np.concatenate(([held["state"][k]], after[:-1]))
                starts = ~inside & text
                total = np.cumsum(size[at])
                since = np.maximum.accumulate(np.where(starts, total - size[at], -held["run"][k]))
                out[f"inside{k}"][at], out[f"after{k}"][at] = inside, after
                out[f"record{k}"][at] = held["records"][k] + np.cumsum(starts)
                out[f"run{k}"][at] = total - since
                held["state"][k], held["records"][k], held["run"][k] = bool(after[-1]), int(out[f"record{k}"][end - 1]), int(out[f"run{k}"][end - 1])
        yield pa.StructArray.from_arrays([pa.array(x) for x in out.values()], list(out))


def walked(lines: DataFrame, sep: str) -> DataFrame:
    """Lines with ``at``, where they stand in their split under both assumptions."""
    v = F.col("value")
    quoted = F.instr(v, '"') > 0
    open0 = F.coalesce(quoted & opens(v, sep), F.lit(False))
    open1 = F.coalesce(~quoted | stays_inside(v, sep), F.lit(True))
    return lines.withColumn("at", _walk(F.xxhash64("file", "block"), open0, open1, _blank(v), F.octet_length(v).cast("long")))


@dataclass
class Structure:
    """What a walk over all lines found. ``splits`` has a row per split: file, block, inside
    (how it begins), line_offset and record_offset (what stands before it in the file), header
    (its number in ``headers``) and header_line of its file, unclosed (the record that its file
    ends within, or null)."""

    splits: DataFrame
    headers: list[str]  # by the first file that has each
    rows: int
    multiline: bool  # some record has several lines, or is never closed
    longest: int  # no record has more bytes than this, unless it fills whole splits (then it is large)
    odd: int  # lines that are not UTF-8
    plain: bool  # no line has a quote or another character that the parser takes for more than text


#: Different headers of one read.
MOST_HEADERS = 1000


def _blank(value: Column) -> Column:
    none = F.length(F.trim(value)) == 0
    return none | ((F.instr(value, "\r") > 0) & (F.length(F.trim(F.regexp_replace(value, "\r", ""))) == 0))


def plain(value: Column) -> Column:
    """Whether a line has no quote and no character that the parser takes for more than text (a
    carriage return before the end, NUL, a byte-order mark): its fields stand between its separators."""
    return (F.instr(value, '"') == 0) & ~value.startswith("\ufeff") & (F.instr(value, "\0") == 0) & ~F.instr(value, "\r").between(F.lit(1), F.length(value) - 1)


def _walked_splits(lines: DataFrame, sep: str) -> DataFrame:
    at = F.col("at")
    after = F.max(at["line"] * 4 + at["after0"].cast("int") * 2 + at["after1"].cast("int"))
    return walked(lines, sep).groupBy("file", "block").agg(
        (F.max(at["line"]) + 1).alias("lines"), (after % 4).alias("after"), F.max(at["record0"]).alias("record0"), F.max(at["record1"]).alias("record1"),
        F.max(at["run0"]).alias("run0"), F.max(at["run1"]).alias("run1"), F.max(at["inside0"] | at["after0"]).alias("open"), F.count_if("odd").alias("odd"),
        F.min(plain(F.col("value"))).alias("plain"),
        # one line a split; a collected list, as a string cannot be the buffer of a hash aggregate
        F.collect_list(F.when(at["first"], F.struct(at["line"].alias("line"), "value"))).alias("head"),
    )


def _plain_splits(lines: DataFrame, sep: str) -> DataFrame:
    """The same row per split, right if ``open`` is false in all of them: then no line begins
    inside a quoted field, its place is its record's, and no text leaves the JVM."""
    # rising in the order of a split's lines, without gaps: it is read by one task
    placed = lines.select("*", F.monotonically_increasing_id().alias("place"))
    v, place = F.col("value"), F.when(~_blank(F.col("value")), F.col("place"))
    zero = F.lit(0).cast("long")
    each = placed.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.count(place).alias("records"), F.max(F.coalesce(opens(v, sep), F.lit(False))).alias("open"), F.count_if("odd").alias("odd"),
        F.min(plain(v)).alias("plain"),
        F.min("place").alias("begin"), F.min_by("value", place).alias("value"), F.min(place).alias("place"),
        F.collect_list(F.lit(None).cast("int")).alias("none"),  # an aggregate by hash though the first line is text
    )
    head = F.when(F.col("place").isNotNull(), F.array(F.struct((F.col("place") - F.col("begin")).alias("line"), "value"))).otherwise(F.array())
    return each.select(
        "file", "block", "lines", zero.alias("after"), F.col("records").alias("record0"), F.col("records").alias("record1"),
        zero.alias("run0"), zero.alias("run1"), "open", "odd", "plain", head.alias("head"))


def structure(lines: DataFrame, sep: str, broken: bool = False) -> Structure:
    """The structure from one scan of the lines, without the walk; from a second one with it, if
    some line ends inside a quoted field. ``broken`` says that this is expected: the walk at once."""
    if not broken:
        found = _structure(_plain_splits(lines, sep))
        if not found.multiline:
            return found
    return _structure(_walked_splits(lines, sep))


def _structure(each: DataFrame) -> Structure:
    """A small shuffle of the splits by file, their table saved."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    file = Window.partitionBy("file")
    after0, after1 = F.col("after") >= 2, F.col("after") % 2 == 1
    told = each.select("*", after0.alias("after0"), after1.alias("after1"), (after0 & ~after1).cast("int").alias("flip"), F.get("head", F.lit(0)).alias("first"))
    told = told.withColumn("flips", F.sum("flip").over(upto))
    settled = F.last(F.when(F.col("after0") == F.col("after1"), F.struct(F.col("after0").alias("state"), "flips")), ignorenulls=True).over(before)
    told = told.withColumn("settled", settled)
    turned = (F.coalesce(F.sum("flip").over(before), F.lit(0)) - F.coalesce(F.col("settled.flips"), F.lit(0))) % 2 == 1
    told = told.withColumn("inside", F.coalesce(F.col("settled.state"), F.lit(False)) != turned)
    told = told.withColumn("records", F.when(F.col("inside"), F.col("record1")).otherwise(F.col("record0")))
    told = told.withColumns({
        "line_offset": F.coalesce(F.sum("lines").over(before), F.lit(0)), "record_offset": F.coalesce(F.sum("records").over(before), F.lit(0)),
        "ends": F.when(F.col("inside"), F.col("after1")).otherwise(F.col("after0")),
    })
    top = F.min(F.when(F.col("first").isNotNull(), F.struct((F.col("line_offset") + F.col("first.line") + 1).alias("line"), F.col("first.value").alias("value")))).over(file)
    last = F.max(F.struct("block", "ends", (F.col("record_offset") + F.col("records")).alias("record"))).over(file)
    told = told.withColumns({"top": top, "last": last})
    splits = told.select(
        "file", "block", "lines", "inside", "line_offset", "record_offset", F.col("top.value").alias("header"), F.col("top.line").alias("header_line"),
        F.when(F.col("last.ends"), F.col("last.record")).alias("unclosed"), "open", "odd", "plain",
        # a split that lies inside one record says nothing of the record's length
        F.when(F.col("inside"), F.when(F.col("record1") == 0, F.lit(1 << 60)).otherwise(F.col("run1"))).otherwise(F.col("run0")).alias("run"),
    )
    ensure_checkpoint_dir(each.sparkSession)
    splits = splits.checkpoint(eager=True)
    found = splits.where("header is not null").groupBy("header").agg(F.min("file").alias("file")).limit(MOST_HEADERS + 1).collect()
    if len(found) > MOST_HEADERS:
        raise ValueError(f"the files have more than {MOST_HEADERS} different headers")
    r = splits.agg(F.count("*").alias("rows"), F.max("open").alias("open"), F.max("run").alias("run"), F.sum("odd").alias("odd"), F.min("plain").alias("plain")).first()
    headers = [x["header"] for x in sorted(found, key=lambda x: x["file"])]
    # on the small table: the number of a file's header, for what is joined to the lines
    which = F.array_position(F.array(*map(F.lit, headers)), F.col("header")) - 1 if headers else F.lit(None).cast("long")
    return Structure(splits.drop("open", "run", "odd", "plain").withColumn("header", which.cast("int")), headers, r["rows"], bool(r["open"]), 2 * (r["run"] or 0), r["odd"] or 0, bool(r["plain"]))


def numbered(lines: DataFrame, sep: str, found: Structure) -> DataFrame:
    """Non-blank lines without the headers: file, number (its place in the file), value, record
    (its record's place), single (a record by itself), whole (its record is closed), header."""
    splits = F.broadcast(found.splits) if found.rows <= BROADCAST_SPLITS else found.splits
    at, inside = F.col("at"), F.col("inside")
    pick = lambda name: F.when(inside, at[f"{name}1"]).otherwise(at[f"{name}0"])
    rows = walked(lines, sep).join(splits, ["file", "block"]).select(
        "file", (F.col("line_offset") + at["line"] + 1).alias("number"), "value", (F.col("record_offset") + pick("record")).alias("record"),
        pick("inside").alias("begins"), pick("after").alias("ends"), "header", "header_line", "unclosed",
    )
    rows = rows.where((F.col("begins") | ~_blank(F.col("value"))) & (F.col("number") != F.col("header_line")))
    return rows.select(
        "file", "number", "value", "record", (~F.col("begins") & ~F.col("ends")).alias("single"),
        F.coalesce(F.col("record") != F.col("unclosed"), F.lit(True)).alias("whole"), "header",
    )


def unnumbered(lines: DataFrame, found: Structure) -> DataFrame | None:
    """Non-blank lines without the headers (value, header) where every line is a record: by their
    file alone, so without the walk. A header is known by its text; None if some line after it
    has the same one, or the files are too many to be broadcast: then its place must tell."""
    if found.multiline or found.rows > BROADCAST_SPLITS:
        return None
    files = found.splits.where("header is not null").select("file", "header").distinct()
    tops = F.broadcast(files.select("file", "header", F.get(F.array(*map(F.lit, found.headers)), F.col("header")).alias("top")))
    rows = lines.select("file", "value").join(tops, "file")
    same = rows.where(F.col("value") == F.col("top")).groupBy("file").count()
    if same.where("count > 1").limit(1).count():
        return None
    return rows.where((F.col("value") != F.col("top")) & ~_blank(F.col("value"))).select("value", "header")


def assembled(rows: DataFrame, found: Structure) -> tuple[DataFrame, DataFrame]:
    """Records (file, number of the first line, value, header) out of numbered lines, and the
    lines that make none: of records that are never closed, or longer than the bound."""
    single = rows.where("single").select("file", "number", "value", "header")
    several = rows.where("not single and whole")
    left = rows.where("not single and not whole")
    if found.longest > MOST_RECORD_BYTES:
        size = several.groupBy("file", "record").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
        large = size.where(F.col("bytes") > MOST_RECORD_BYTES).select("file", "record")
        left = left.unionByName(several.join(large, ["file", "record"], "left_semi"))
        several = several.join(large, ["file", "record"], "left_anti")
    lines = F.array_sort(F.collect_list(F.struct("number", "value")))
    whole = several.groupBy("file", "record").agg(lines.alias("lines"), F.first("header").alias("header"))
    joined = whole.select("file", F.col("lines")[0]["number"].alias("number"), F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"), "header")
    return single.unionByName(joined), left.select("file", "number", "value", "header")

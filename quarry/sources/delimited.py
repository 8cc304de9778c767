"""Delimited-text ingest (S1-S6, P1, P4): sniff, decode, shape-check, parse, type.

The files are read as lines (splittable, so any number of tasks per file). One scan finds what
the lines depend on (:mod:`quarry.sources.records`): each file's header, which lines belong to
quoted fields with line breaks, line numbers, lines that are not UTF-8. Then, per line:

* bytes that are not valid UTF-8 are decoded as ISO-8859-1 (the reference's fallback
  chain ends in a one-byte code page; no character is dropped);
* blank lines are removed, and of each file its first other line, the header;
* each file's fields go by its own header: columns of one name are one column, whatever
  their place, and a column that a file lacks is NULL there;
* the number of fields, with quotes counted as the parser does (a quote opens a field only
  at the field's start), decides the row's fate: more fields than the header -> the rejects
  table (pandas ``on_bad_lines='skip'``), with the line's file and number; fewer -> kept and
  padded with NULL (``strict=True`` rejects those too, the reference's repair reader);
* ``from_csv`` splits the kept records into all-text columns; missing-value tokens become
  NULL.

``multiline=True`` puts records over several lines together. Without it every line of such a
record is a reject, none of them a row. Lines of a quoted field that its file never closes, or
that is longer than ``records.MOST_RECORD_BYTES``, are rejects in both modes.

Names are then normalized (P1), types promoted from whole-column evidence (P2, P3) and
all-empty rows dropped (P4). Only the sniff (first lines of one file), the different headers
and the type evidence (one aggregate row) reach the driver.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import normalize_names
from quarry.functions.parse import null_tokens
from quarry.functions.tokens import DELIMITERS, NA_TOKENS
from quarry.operators.clean import Promotion, apply_promotion, drop_empty_rows, promotion_plan
from quarry.sources import records as R

SNIFF_LINES = 10
_ONE_BYTE = {"latin-1", "latin1", "iso-8859-1", "iso8859-1", "cp1252", "windows-1252"}


@dataclass
class Ingested:
    """A typed table, the lines that did not fit, and what was learned on the way."""

    df: DataFrame
    rejects: DataFrame
    raw: DataFrame
    metadata: dict = field(default_factory=dict)
    #: The typed table, its records and rejected records counted by an observation as it is used.
    watched: Callable[[Observation], DataFrame] | None = None
    #: Lines that belong to no record; None where every line is one.
    broken: DataFrame | None = None

    def with_counts(self) -> dict:
        """Metadata plus ``original_shape`` / ``processed_shape`` and the number of rejects
        (one aggregate over the records, one over the lines)."""
        ncol = len(self.raw.columns)
        all_null = F.lit(True)
        for c in self.raw.columns:
            all_null = all_null & F.col(f"`{c}`").isNull()
        r = self.raw.agg(F.count(F.lit(1)).alias("n"), F.count_if(~all_null).alias("kept")).first()
        meta = dict(self.metadata)
        meta["file_size_mb"] = total_size_mb(self.raw.sparkSession, meta["file_path"])
        meta["original_shape"] = [r["n"], ncol]
        meta["processed_shape"] = [r["kept"], len(self.df.columns)]
        meta["errors_found"] = self.rejects.count()
        return meta


def list_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Files behind a path, directory or glob, sorted (from the file index; no job runs)."""
    try:
        files = spark.read.text(path).inputFiles()
    except Exception as e:  # noqa: BLE001 - the reader raises analysis errors for missing paths
        raise FileNotFoundError(f"no input at {path}: {type(e).__name__}") from e
    if not files:
        raise FileNotFoundError(f"no input at {path}")
    return sorted(files)


def total_size_mb(spark: SparkSession, path) -> float:
    """Input size in MB (file metadata only; the contents are pruned away)."""
    r = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first()
    return (r["n"] or 0) / (1024 * 1024)


#: Separates nothing: a line comes back whole from the line-based CSV reader.
_NO_SEP = "\u0001\u0002\u0001\u0002"
_BYTES = "ISO-8859-1"


def decoded(raw: Column, encoding: str) -> Column:
    """Text from a line whose bytes came in one per character."""
    if (encoding or "auto").lower() in _ONE_BYTE:
        return raw
    text = F.encode(raw, _BYTES).cast("string")
    if encoding.lower() in ("utf-8", "utf8"):
        return text
    return F.when(F.is_valid_utf8(text), text).otherwise(raw)


def _is_utf16(encoding: str | None) -> bool:
    return (encoding or "").lower().replace("-", "") in ("utf16", "utf16le", "utf16be")


def line_reader(reader, header: bool):
    """A batch or stream reader of whole lines, their bytes kept; ``header`` drops the first
    non-blank line of each file."""
    reader = reader.schema("value string").option("sep", _NO_SEP).option("quote", "").option("encoding", _BYTES)
    return reader.option("header", header).option("mode", "PERMISSIVE")


def without_cr(v: Column) -> Column:
    return F.when(v.endswith("\r"), v.substr(F.lit(1), F.length(v) - 1)).otherwise(v)


def read_lines(spark: SparkSession, path, encoding: str = "auto", header: bool = False, valid: bool = False) -> DataFrame:
    """One row per non-blank physical line, decoded: ``value`` and its ``file``. With
    ``header`` the first non-blank line of each file is left out, by its position. ``valid``
    says that all bytes are known to be UTF-8, so that no line is looked at for that again."""
    if _is_utf16(encoding):
        # UTF-16 is not line-splittable as bytes; each file is decoded whole in one task.
        files = spark.read.format("binaryFile").load(path)
        lines = F.filter(F.split(F.decode(F.col("content"), "UTF-16"), "\r?\n"), lambda x: F.length(F.trim(x)) > 0)
        lines = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))) if header else lines
        return files.select(F.explode(lines).alias("value"), F.col("path").alias("file"))
    lines = line_reader(spark.read, header)
    lines = lines.option("encoding", "UTF-8").csv(path) if valid else lines.csv(path)
    text = F.col("value") if valid else decoded(F.col("value"), encoding or "auto")
    return lines.select(text.alias("value"), F.col("_metadata.file_path").alias("file")).where(F.length(F.trim("value")) > 0)


def sniff_delimiter(lines: list[str]) -> str:
    """Among ``, TAB ; |``, the one with the same non-zero count on every sampled line;
    the largest count wins; ``,`` when none qualifies."""
    best, best_n = ",", 0
    for d in DELIMITERS:
        counts = {ln.count(d) for ln in lines}
        if len(counts) == 1:
            n = counts.pop()
            if n > best_n:
                best, best_n = d, n
    return best


def _head(spark: SparkSession, file: str, encoding: str) -> list:
    if _is_utf16(encoding):
        return read_lines(spark, file, encoding).select("value", F.lit("").alias("bom")).limit(SNIFF_LINES).collect()
    raw = read_lines(spark, file, _BYTES)
    text = decoded(F.col("value"), encoding or "auto")
    return raw.select(text.alias("value"), F.hex(F.encode(F.substring("value", 1, 2), _BYTES)).alias("bom")).limit(SNIFF_LINES).collect()


_UTF16_BOMS = ("FFFE", "FEFF")


def sniff(spark: SparkSession, path, encoding: str = "auto") -> dict:
    """The header, delimiter and encoding guess from the first non-blank lines of the first
    non-empty file (in path order); one small job in the usual case. A UTF-16 byte-order
    mark switches an ``auto`` read to UTF-16; otherwise ``auto`` is decided line by line."""
    files = list_files(spark, path)
    head = _head(spark, files[0], encoding)
    if not head and len(files) > 1:
        # the first file is empty (writers leave empty part files): the first with bytes
        full = spark.read.format("binaryFile").load(files).where("length > 0").agg(F.min("path").alias("p")).first()["p"]
        if full is not None:
            head = _head(spark, full, encoding)
            files = [full, *(x for x in files if x != full)]
    if (encoding or "auto") == "auto" and head and head[0]["bom"] in _UTF16_BOMS:
        encoding = "utf-16"
        head = _head(spark, files[0], encoding)
    sample = [_strip_bom(r["value"].rstrip("\r")) for r in head]
    if not sample:
        raise ValueError(f"no lines in {path}")
    return {"files": files, "sample": sample, "header": sample[0], "delimiter": sniff_delimiter(sample), "encoding": encoding or "auto"}


def _strip_bom(text: str) -> str:
    return text[1:] if text.startswith("\ufeff") else text


def separators(text: Column, sep: str) -> Column:
    size = F.octet_length if sep.isascii() else F.length
    return size(text) - size(F.replace(text, F.lit(sep), F.lit("")))


def field_count(value: Column, sep: str) -> Column:
    """The number of fields as the parser counts them, in linear time; NULL when a quote that
    opens a field is never closed. Quoted fields are taken out (a quote elsewhere is text),
    then separators are counted."""
    bare = R.bare(value, sep)
    count = separators(bare, sep) + F.lit(1)
    return F.when((F.instr(bare, '"') == 0) | ~bare.rlike(rf'(^|{re.escape(sep)})"'), count)


def parseable(value: Column, sep: str) -> Column:
    """A record as Spark's parser reads it like the reference's: what follows a closing quote in
    its field (``"a"b``) is taken into the quotes."""
    d = re.escape(sep)
    return F.when(F.instr(value, '"') > 0, F.regexp_replace(value, rf'(^|{d})"([^"]*+(?:""[^"]*+)*+)"([^"{d}]++)(?={d}|\z)', '$1"$2$3"')).otherwise(value)


def _split_header(header: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(_strip_bom(header.rstrip("\r"))), delimiter=sep, quotechar='"'))


def _shaped(rows: DataFrame, sep: str, width: int, more: list[str], blank_is_null: bool, every_plain: bool) -> DataFrame:
    """Records with their field count and parsed fields: value, n, cells (NULL for an empty field
    without quotes) and ``more``. A record without quotes and the like (``R.plain``) is cut at its
    separators, with the parser's result; if the scan found ``every_plain``, there is no other."""
    v = F.col("value")
    # Materialize the cleaned record once: the expressions above nest the decode several times,
    # and collapsed projections would repeat it in every consumer (filter, count, from_csv).
    lines = rows.select(F.inline(F.array(F.struct(without_cr(v).alias("value"), *more))))
    cut = F.split(v, re.escape(sep), -1)
    if not blank_is_null:
        cut = F.transform(cut, lambda x: F.nullif(x, F.lit("")))
    n = separators(v, sep) + F.lit(1)
    if every_plain:
        return lines.select("value", *more, n.alias("n"), cut.alias("cells"))
    n = F.when(F.instr(v, '"') == 0, n).otherwise(field_count(v, sep))
    opts = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    row = F.when(~(R.plain(v) & (F.instr(v, "\r") == 0)), F.from_csv(parseable(v, sep), text_fields(width), opts))
    parsed = lines.select("value", *more, n.alias("n"), row.alias("r"))
    cells = F.when(F.col("r").isNull(), cut).otherwise(F.array(*(F.col(f"r._c{i}") for i in range(width))))
    return parsed.select("value", *more, "n", cells.alias("cells"))


def text_fields(width: int) -> str:
    return ", ".join(f"_c{i} string" for i in range(width))


@dataclass
class _Columns:
    """The columns of files with several headers: names in the order in which they come up, and
    where each header has them."""

    headers: list[list[str]]  # clean names, per header
    mapping: dict[str, str]

    @classmethod
    def of(cls, headers: list[str], sep: str) -> _Columns:
        clean, mapping = [], {}
        for h in headers:
            names, own = normalize_names(_split_header(h, sep))
            clean.append(names)
            mapping |= own
        return cls(clean, mapping)

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(n for h in self.headers for n in h))

    @property
    def width(self) -> int:
        return max(map(len, self.headers))

    def expected(self, header: Column) -> Column:
        """How many fields a record should have."""
        sizes = {}
        for i, h in enumerate(self.headers):
            sizes.setdefault(len(h), []).append(i)
        out = F.lit(self.width)
        for size, which in sizes.items():
            out = F.when(header.isin(which), F.lit(size)).otherwise(out) if size != self.width else out
        return out

    def value(self, name: str, header: Column) -> Column:
        """A column's field among the ``cells`` of a record, by the record's header."""
        places = {}
        for i, h in enumerate(self.headers):
            places.setdefault(h.index(name) if name in h else None, []).append(i)
        if len(places) == 1:
            return F.get("cells", F.lit(next(iter(places))))
        out = F.lit(None).cast("string")
        for place, which in places.items():
            if place is not None:
                out = F.when(header.isin(which), F.get("cells", F.lit(place))).otherwise(out)
        return out


_UTF16_MARKS = ("\xff\xfe", "\xfe\xff")


def _breaks(sample: list[str], sep: str) -> bool:
    """Whether one of the first lines ends inside a quoted field."""
    return any(re.search(rf'(^|{re.escape(sep)})"[^"]*(""[^"]*)*$', line) for line in sample)


def _lines(spark: SparkSession, files: list[str], encoding: str, sep: str, broken: bool) -> tuple[DataFrame, R.Structure, bool]:
    """All lines, their structure, and whether files of UTF-16 are among others."""
    lines = R.physical_lines(spark, files, encoding)
    found = R.structure(lines, sep, broken)
    marked = [i for i, h in enumerate(found.headers) if h.startswith(_UTF16_MARKS)]
    if not marked or encoding != "auto":
        return lines, found, False
    wide = [r["file"] for r in found.splits.where(F.col("header").isin(marked)).select("file").distinct().collect()]
    rest = lines.where(~F.col("file").isin(wide))
    lines = rest.unionByName(R.physical_lines(spark, wide, "utf-16"))
    return lines, R.structure(lines, sep, broken), True


def read_delimited(
    spark: SparkSession,
    path,
    sep: str | None = None,
    encoding: str = "auto",
    strict: bool = False,
    na_tokens: list[str] | None = None,
    promote: bool = True,
    dayfirst: bool | None = None,
    multiline: bool = False,
    lenient: float | None = None,
) -> Ingested:
    """S1-S6 + P1-P4: a delimited file (or many) as a typed DataFrame.

    ``sep`` is sniffed when not given. ``strict`` keeps only records with exactly the header's
    field count. ``promote=False`` leaves every column as text. ``multiline`` reads quoted
    line breaks. ``dayfirst`` settles the order of day and month, which the values decide
    otherwise. ``lenient`` is the share of dates from which a column becomes one, its other
    values NULL and counted in the metadata.
    """
    info = sniff(spark, path, encoding)
    encoding = info["encoding"]
    sep = sep or info["delimiter"]
    # a guess: it spares a scan, no result depends on it
    lines, found, mixed = _lines(spark, info["files"], encoding, sep, multiline or _breaks(info["sample"], sep))
    columns = _Columns.of(found.headers, sep)
    numbered = R.numbered(lines, sep, found)
    hid = F.col("header")
    valid = not found.odd and not mixed and encoding.lower() in ("auto", "utf-8", "utf8")
    if not found.multiline and len(found.headers) == 1 and not mixed and not R.is_utf16(encoding):
        # every line is a record under one header: no line's place matters
        rows = read_lines(spark, path, encoding, header=True, valid=valid).withColumn("header", F.lit(0))
        broken = None
    elif (plain := R.unnumbered(R.physical_lines(spark, info["files"], "utf-8") if valid else lines, found)) is not None:
        rows, broken = plain, None
    elif multiline:
        rows, broken = R.assembled(numbered, found)
    else:
        rows, broken = numbered.where("single"), numbered.where("not single")

    def fits(shaped: DataFrame) -> Column:
        n, want = F.col("n"), columns.expected(hid)
        return F.coalesce((n == want) if strict else (n <= want), F.lit(False))

    blank_is_null = "" in (NA_TOKENS if na_tokens is None else na_tokens)
    shaped = _shaped(rows, sep, columns.width, ["header"], blank_is_null, found.plain)
    placed = _shaped(numbered if broken is None else rows, sep, columns.width, ["file", "number", "header"], blank_is_null, found.plain)
    said = ["line", "expected", "found", "file", "line_number"]
    rejects = placed.where(~fits(placed)).select(F.col("value").alias(said[0]), columns.expected(hid).alias(said[1]), F.col("n").cast("int").alias(said[2]), "file", F.col("number").alias(said[4]))
    if broken is not None:
        rejects = rejects.unionByName(broken.select(
            without_cr(F.col("value")).alias(said[0]), columns.expected(hid).alias(said[1]), F.lit(None).cast("int").alias(said[2]), "file", F.col("number").alias(said[4])))
    placed_fields = [columns.value(c, hid).alias(c) for c in columns.names]
    fields = [null_tokens(F.col(f"`{c}`"), na_tokens).alias(c) for c in columns.names]

    def records(counted: DataFrame) -> DataFrame:
        # one materialized row of fields, so the type evidence and casts reuse them; found and
        # cleared in two steps, as the code of both together grows too long for the JVM to compile
        found_fields = counted.where(fits(counted)).select(F.inline(F.array(F.struct(*placed_fields))))
        return found_fields.select(F.inline(F.array(F.struct(*fields))))

    raw = records(shaped)
    decisions, failures = Promotion(), {}
    if promote:
        decisions = promotion_plan(raw, dayfirst, lenient, failures)

    def typed(rows: DataFrame) -> DataFrame:
        return drop_empty_rows(apply_promotion(rows, decisions, dayfirst) if promote else rows)

    def watched(seen: Observation) -> DataFrame:
        return typed(records(shaped.observe(seen, F.count_if(fits(shaped)).alias("records"), F.count_if(~fits(shaped)).alias("rejects"))))

    df = typed(raw)
    used = encoding
    if encoding == "auto":
        used = "utf-8, else iso-8859-1" if found.odd else "utf-8"
        used += ", utf-16" if mixed else ""
    meta = {
        "file_path": path if isinstance(path, str) else list(path),
        "file_size_mb": None,
        "load_timestamp": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"),
        "encoding_used": used,
        "delimiter": sep,
        "column_mapping": columns.mapping,
        "dtypes": {f.name: f.dataType.simpleString() for f in df.schema.fields},
        "promotions": dict(decisions),
        "date_failures": failures,
    }
    return Ingested(df=df, rejects=rejects, raw=raw, metadata=meta, watched=watched, broken=broken)


def load_delimited(spark: SparkSession, path, save_to: str | None = None, **options) -> tuple[bool, str, Ingested | None]:
    """S1 with the reference's contract: ``(ok, message, result)`` instead of raising.

    A missing path or an unreadable file gives ``ok=False`` and the reason. On success the
    metadata gains the row counts. With ``save_to`` the clean table (Parquet) and the metadata
    (JSON) are written there (S7, S8) and the counts are taken while the table is written.
    """
    from quarry.sources import sinks
    try:
        ing = read_delimited(spark, path, **options)
        ing.metadata = sinks.write_load(spark, ing, save_to) if save_to else ing.with_counts()
    except FileNotFoundError:
        return False, f"nothing to read at {path}", None
    except Exception as e:  # noqa: BLE001 - reported, as the reference does
        return False, f"{path} is not readable as a table: {type(e).__name__}: {e}", None
    rows, cols = ing.metadata["processed_shape"]
    return True, f"{rows:,} rows in {cols} columns from {path}", ing

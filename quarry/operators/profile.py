"""Column profiling.

A whole table is profiled in two steps, however many columns it has:

1. **Evidence**: aggregates over every column (row count, non-null count, min/max,
   integrality, infinities, and for text the boolean-word, date-shape and number-shape
   tests plus the mean length), packed under the whole-stage-codegen field limit. That
   is one aggregate for a table of a dozen columns, a few for wide ones; each reads only
   its own columns. One row of numbers comes back per aggregate.
2. **Frequencies**: the columns are unpivoted to ``(pos, value)``, with the value in a
   typed slot (long / double / text / SHA-256 of text), and counted with one group-by
   (partial aggregation collapses repeated values map-side). Text columns that can be
   categorical are unpivoted by value: inside ``(pos, hash(value) mod S)`` slices the values
   are counted and ranked, and the at most ``3*S`` survivors per column give the three most
   frequent, so no single task ranks all values of a large column. The other columns need
   the exact distinct count alone, text by its digest.

The per-column facts (a few numbers per column) are then assembled into the profile
table on the driver; its size is bounded by the number of columns.

Type rules, in order (whole-column evidence, so the result does not depend on row order):
all NULL -> ``empty``; boolean type -> ``boolean``; numeric -> ``unknown`` if any +-inf,
else ``integer`` when every value is whole, else ``float``; date/time type -> ``datetime``;
text: at most three distinct boolean words -> ``boolean``; every value a date ->
``datetime``; every value a number once ``, $ %`` and spaces are removed ->
``numeric_string``; distinct ratio < 0.5 and mean length < 50 -> ``categorical``;
else ``text``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.missing import without_nan
from quarry.functions.dates import column_formats, maybe_date
from quarry.functions.parse import is_integer_text, is_number_text
from quarry.functions.tokens import BOOLEAN_WORDS, CARDINALITY_LOW_MAX, CARDINALITY_MEDIUM_MAX
from quarry.session import spread

PROFILE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("nulls", T.LongType()),
    T.StructField("null_pct", T.DoubleType()),
    T.StructField("unique", T.LongType()),
    T.StructField("cardinality", T.StringType()),
    T.StructField("range_min", T.DoubleType()),
    T.StructField("range_max", T.DoubleType()),
    T.StructField("top_values", T.ArrayType(T.StringType())),
])

TOP_K = 3
TOP_SALT = 64
NUMERIC_ROLES = ("integer", "float", "numeric_string")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, T.NumericType):
        return "num"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(dt, T.StringType):
        return "text"
    return "other"


def _as_text(name: str, dt: T.DataType) -> Column:
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(_q(name))
    return _q(name).cast("string")


# -- evidence ----------------------------------------------------------------------

# Aggregation buffers wider than Spark's whole-stage-codegen field limit (100) run on the
# interpreted path; evidence is packed into aggregates under this many buffer fields.
# Parquet reads only the columns an aggregate touches, so more aggregates cost little I/O.
FIELD_BUDGET = 96

def _word_index(word: Column) -> Column:
    """1-based position of a boolean word (0 when not one)."""
    return F.array_position(F.array(*[F.lit(w) for w in BOOLEAN_WORDS]), word)


def evidence_exprs(i: int, name: str, dt: T.DataType, text_tests: bool = True) -> list[tuple[int, Column]]:
    """``(buffer fields, aggregate)`` pairs for one column, aliased ``e{i}_<fact>``."""
    c = _q(name)
    kind = _kind(dt)
    out = [(1, F.count(c).alias(f"e{i}_nn"))]
    if kind == "num":
        out += [(1, F.min(c).cast("double").alias(f"e{i}_min")), (1, F.max(c).cast("double").alias(f"e{i}_max"))]
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            out += [
                (1, F.bool_and(F.when(c.isNotNull(), c == F.floor(c))).alias(f"e{i}_whole")),
                (1, F.bool_or(F.when(c.isNotNull(), F.abs(c) == F.lit(float("inf")))).alias(f"e{i}_inf")),
            ]
        elif isinstance(dt, T.DecimalType):
            out += [(1, F.bool_and(F.when(c.isNotNull(), c == F.floor(c))).alias(f"e{i}_whole"))]
    elif kind in ("text", "other"):
        t = c if kind == "text" else _as_text(name, dt)
        out += [(2, F.avg(F.length(t)).alias(f"e{i}_len"))]
        if kind == "text" and text_tests:
            word = F.lower(F.trim(t))
            idx = _word_index(word)
            nn = t.isNotNull()
            out += [
                (1, F.bool_and(F.when(nn, idx > 0)).alias(f"e{i}_allword")),
                # one bit per boolean word seen: the distinct-word count without a set
                (1, F.bit_or(F.when(idx > 0, F.pow(F.lit(2), idx - 1).cast("long"))).alias(f"e{i}_words")),
                (1, F.bool_and(F.when(nn, maybe_date(t))).alias(f"e{i}_maybe")),
                (1, F.bool_and(F.when(nn, is_number_text(t))).alias(f"e{i}_num")),
                (1, F.bool_and(F.when(nn, is_integer_text(t))).alias(f"e{i}_int")),
                (1, F.bool_and(F.when(nn, t.isin("True", "TRUE", "true", "False", "FALSE", "false"))).alias(f"e{i}_tf")),
            ]
    return out


def _budgeted(items: list[tuple[int, Column]], budget: int = FIELD_BUDGET) -> list[list[Column]]:
    chunks: list[list[Column]] = [[]]
    used = 0
    for n, e in items:
        if used + n > budget and chunks[-1]:
            chunks.append([])
            used = 0
        chunks[-1].append(e)
        used += n
    return chunks


def column_evidence(df: DataFrame, text_tests: bool = True, extra: list[tuple[int, Column]] | None = None
                    ) -> tuple[int, list[dict]]:
    """Job 1: ``(rows, [facts per column])`` from field-budgeted aggregates over all columns;
    text columns whose every value may be a date get the two jobs that tell."""
    items: list[tuple[int, Column]] = [(1, F.count(F.lit(1)).alias("rows"))]
    for i, f in enumerate(df.schema.fields):
        items += evidence_exprs(i, f.name, f.dataType, text_tests)
    chunks = _budgeted(items)
    if extra:  # sketches are not code-generated anyway: one aggregate for all of them
        chunks.append([e for _, e in extra])
    row: dict = {}
    for chunk in chunks:
        row.update(df.agg(*chunk).first().asDict())
    facts = []
    for i, f in enumerate(df.schema.fields):
        pre = f"e{i}_"
        d = {k[len(pre):]: v for k, v in row.items() if k.startswith(pre)}
        d["name"], d["dtype"], d["kind"] = f.name, f.dataType, _kind(f.dataType)
        if "words" in d:
            d["nword"] = bin(d["words"] or 0).count("1")
        facts.append(d)
    formats = column_formats(df, [d["name"] for d in facts if d.get("maybe")])
    for d in facts:
        d["date"] = d["name"] in formats and formats[d["name"]].valid == d["nn"]
    return row["rows"], facts


# -- frequencies -------------------------------------------------------------------

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _slots(name: str, dt: T.DataType, digest: bool = False) -> tuple[Column, Column, Column, Column]:
    """The value in a typed slot: whole numbers as long, floats as double (where Spark's
    grouping already treats -0.0 as 0.0), everything else as text. Exactly one slot is set,
    so grouping on all of them keeps values distinct without casting numbers to text.

    With ``digest``, text goes as its SHA-256 digest into a fourth, binary slot: a distinct
    count then shuffles 32 bytes a value instead of whole texts (a collision is as likely as
    breaking SHA-256).
    """
    c = _q(name)
    nl, nd, ns = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    nh = F.lit(None).cast("binary")
    if isinstance(dt, _INTEGRAL):
        return c.cast("long"), nd, ns, nh
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return nl, c.cast("double"), ns, nh
    t = _as_text(name, dt)
    return (nl, nd, ns, F.unhex(F.sha2(t, 256))) if digest else (nl, nd, t, nh)


def frequency_table(df: DataFrame, positions: list[int] | None = None, digest: bool = False) -> DataFrame:
    """``(pos, l, d, s, h, cnt)``: count per non-NULL value of each column, value in its slot."""
    fields = list(enumerate(df.schema.fields))
    if positions is not None:
        keep = set(positions)
        fields = [(i, f) for i, f in fields if i in keep]
    cells = []
    for i, f in fields:
        l, d, s, h = _slots(f.name, f.dataType, digest)
        cells.append(F.struct(F.lit(i).alias("pos"), l.alias("l"), d.alias("d"), s.alias("s"), h.alias("h")))
    present = F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull() | F.col("h").isNotNull()
    return (
        df.select(F.inline(F.array(*cells)))
        .where(present)
        .groupBy("pos", "l", "d", "s", "h")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def text_frequencies(freq: DataFrame) -> DataFrame:
    """``(pos, v, cnt)`` with the value as text, for ranking."""
    v = F.coalesce(F.col("s"), F.col("l").cast("string"), F.col("d").cast("string"))
    return freq.select("pos", v.alias("v"), "cnt")


def ranked_values(freq: DataFrame, k: int = TOP_K, salt: int = TOP_SALT) -> DataFrame:
    """``(pos, unique, tv)``: per column of a ``(pos, v, cnt)`` table the number of values and
    the k most frequent as an array of (v, cnt), ties by value.

    Values are ranked and counted inside ``(pos, hash(value) mod salt)`` slices first. Every
    global top-k row is in the top-k of its own slice, so the at most ``k * salt`` survivors
    per column decide, and the slices' counts add up.
    """
    w = Window.partitionBy("pos", "s")
    sliced = freq.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salt)))
    local = sliced.withColumns({
        "rk": F.row_number().over(w.orderBy(F.desc("cnt"), F.asc("v"))), "n": F.count(F.lit(1)).over(w),
    }).where(F.col("rk") <= k)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("less"), "v"))), 1, k)
    return local.groupBy("pos").agg(
        F.sum(F.when(F.col("rk") == 1, F.col("n"))).alias("unique"),
        F.transform(best, lambda b: F.struct(b["v"].alias("v"), (-b["less"]).alias("cnt"))).alias("tv"),
    )


# -- assembly ----------------------------------------------------------------------

def cardinality(unique: int) -> str:
    """A6."""
    if unique <= CARDINALITY_LOW_MAX:
        return "low"
    if unique <= CARDINALITY_MEDIUM_MAX:
        return "medium"
    return "high"


def infer_type(f: dict, unique: int | None) -> str:
    """A7 over the facts of one column."""
    nn = f.get("nn") or 0
    if nn == 0:
        return "empty"
    kind = f["kind"]
    if kind == "bool":
        return "boolean"
    if kind == "num":
        if f.get("inf"):
            return "unknown"
        whole = f.get("whole", True)
        return "integer" if whole is None or whole else "float"
    if kind == "time":
        return "datetime"
    if kind == "text":
        if f.get("allword") and (f.get("nword") or 0) <= 3:
            return "boolean"
        if f.get("date"):
            return "datetime"
        if f.get("num"):
            return "numeric_string"
    ratio = (unique or 0) / nn
    if ratio < 0.5 and (f.get("len") or 0) < 50:
        return "categorical"
    return "text"


@dataclass
class Profile:
    """The profile table plus the figures the summary needs."""

    rows: int
    columns: list[dict]
    df: DataFrame

    def roles(self) -> dict[str, list[str]]:
        """U4: column names by role, in column order."""
        return roles(self.columns)


def roles(columns: list[dict]) -> dict[str, list[str]]:
    return {
        "dates": [c["name"] for c in columns if c["type"] == "datetime"],
        "numerics": [c["name"] for c in columns if c["type"] in NUMERIC_ROLES],
        "categoricals": [c["name"] for c in columns if c["type"] == "categorical"],
    }


def profile(df: DataFrame, approx: bool = False, rsd: float = 0.02) -> Profile:
    """A10: the profile of every column.

    ``approx=True`` takes distinct counts from ``approx_count_distinct`` inside the evidence
    aggregate and builds frequencies only for the text columns that can be categorical, for
    tables too large for an exact distinct count of every column.
    """
    spark = df.sparkSession
    df = without_nan(df)
    fields = df.schema.fields
    # the unpivot multiplies rows by columns: give a single-split input every core
    df = spread(df)
    if approx:
        extra = [(0, F.approx_count_distinct(_q(f.name), rsd).alias(f"e{i}_aud")) for i, f in enumerate(fields)]
        rows, facts = column_evidence(df, extra=extra)
        uniques = {i: facts[i].get("aud") or 0 for i in range(len(fields))}
    else:
        rows, facts = column_evidence(df)
        uniques = None
    if rows == 0:
        return Profile(0, [], spark.createDataFrame([], PROFILE_SCHEMA))

    # Text columns that could turn out categorical need their top values.
    def maybe_categorical(i: int) -> bool:
        f = facts[i]
        if f["kind"] not in ("text", "other") or not f.get("nn"):
            return False
        if f["kind"] == "text" and ((f.get("allword") and (f.get("nword") or 0) <= 3) or f.get("date") or f.get("num")):
            return False
        return (f.get("len") or 0) < 50

    # every column is unpivoted once: candidates by value, for the count and the ranking;
    # the others for the distinct count only, text among them by digest
    cand = [i for i in range(len(fields)) if maybe_categorical(i)]
    rest = [i for i in range(len(fields)) if i not in cand] if uniques is None else []
    found = []
    if cand:
        found += ranked_values(text_frequencies(frequency_table(df, cand))).collect()
    if rest:
        found += frequency_table(df, rest, digest=True).groupBy("pos").agg(F.count(F.lit(1)).alias("unique"), F.lit(None).alias("tv")).collect()
    tops = {r["pos"]: [(x["v"], x["cnt"]) for x in r["tv"]] for r in found if r["tv"]}
    if uniques is None:
        uniques = {r["pos"]: r["unique"] for r in found}

    columns = []
    for i, f in enumerate(facts):
        u = int(uniques.get(i) or 0)
        nn = f.get("nn") or 0
        typ = infer_type(f, u)
        nulls = rows - nn
        rec = {
            "position": i,
            "name": f["name"],
            "type": typ,
            "nulls": int(nulls),
            "null_pct": nulls / rows * 100,
            "unique": u,
            "cardinality": cardinality(u),
            "range_min": f.get("min") if typ in ("integer", "float") else None,
            "range_max": f.get("max") if typ in ("integer", "float") else None,
            "top_values": [v for v, _ in tops[i]] if typ == "categorical" and i in tops else None,
        }
        if typ == "categorical" and i in tops:
            rec["top_counts"] = [c for _, c in tops[i]]
        columns.append(rec)
    pdf = spark.createDataFrame([tuple(c[k] for k in PROFILE_SCHEMA.names) for c in columns], PROFILE_SCHEMA)
    return Profile(rows, columns, pdf)


def sample_rows(df: DataFrame, order_by: list[str] | None = None, n: int = 3) -> DataFrame:
    """The first n rows by an explicit order, as text: missing values become ``''``,
    dates are rendered ``yyyy-MM-dd HH:mm:ss`` and a missing date stays NULL."""
    keys = order_by or [df.columns[0]]
    cols = []
    for f in df.schema.fields:
        c = _q(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            cols.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            cols.append(F.coalesce(_as_text(f.name, f.dataType), F.lit("")).alias(f.name))
    return df.orderBy(*[_q(k) for k in keys]).limit(n).select(*cols)


def summary(df: DataFrame, prof: Profile, metadata: dict | None = None, order_by: list[str] | None = None) -> dict:
    """A1 + P17: ``{shape, columns, sample_rows, metadata}`` as a plain dict."""
    sample = [r.asDict() for r in sample_rows(df, order_by).collect()] if prof.rows else []
    return {
        "shape": {"rows": prof.rows, "columns": len(df.columns)},
        "columns": prof.columns,
        "sample_rows": sample,
        "metadata": metadata or {},
    }


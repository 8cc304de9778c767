"""Cleaning and typing.

``promote_types`` decides each text column's type from whole-column evidence (one
aggregate) and then applies every cast in one projection. ``display_prep`` is the
dashboard's literal text preparation, kept apart and off by default.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.dates import Formats, column_formats, date_shape, maybe_date, parsed, shape, usual_date, with_dates
from quarry.functions.parse import lenient_double, number_text, parse_datetime, parse_number
from quarry.functions.tokens import DATE_NAME_HINTS, DISPLAY_NULL_TEXT


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


# Aggregates are packed under whole-stage codegen's field limit.
_FIELD_BUDGET = 90


def evidence(df: DataFrame, items: list[Column]) -> dict:
    """The named aggregates over ``df`` as one dict, in as few scans as the field budget allows."""
    out: dict = {}
    for at in range(0, len(items), _FIELD_BUDGET):
        out.update(df.agg(*items[at : at + _FIELD_BUDGET]).first().asDict())
    return out


class Promotion(dict):
    """Target type per text column; ``formats`` says how the dates among them are written,
    ``bare`` which numbers are all written without separators, signs of currency and spaces."""

    formats: dict[str, Formats]
    bare: set[str]


# What a text may be, as flags: a boolean, a number, a whole one that fits a long, a whole one of
# up to 38 digits, a whole one beyond a long, perhaps a date, a number without noise.
_BOOLEAN, _NUMBER, _LONG, _WIDE, _BIG, _DATE, _BARE = (1 << i for i in range(7))
_BARE_LONG = r"^[+-]?[0-9]{1,18}\z"
_BARE_FRACTION = r"^[+-]?(?:[0-9]++\.[0-9]*+(?:[eE][+-]?[0-9]++)?+|\.[0-9]++(?:[eE][+-]?[0-9]++)?+|[0-9]++[eE][+-]?[0-9]++)\z"
#: No number: a character that none has, or a sign after digits.
_NO_NUMBER = r"[^0-9eE+.,$% -]|[0-9.][,$% ]*[+-]"


def text_kind(c: Column) -> Column:
    """What a text may be, as the sum of its flags. A number starts with a character from the
    blank to the 9, so that one look settles most other texts, and the two usual forms are known
    by one pattern each. The flags of the rest are those of the tests in
    :mod:`quarry.functions.parse`."""
    def flag(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    n = number_text(c)
    whole = (
        F.when(n.try_cast("long").isNotNull(), F.lit(_NUMBER + _LONG + _WIDE))
        .when(n.try_cast("decimal(38,0)").isNotNull(), F.lit(_NUMBER + _WIDE + _BIG))
        .otherwise(F.lit(_NUMBER + _BIG))
    )
    rest = F.when(n.rlike(r"^[+-]?[0-9]++\z"), whole).otherwise(flag(n.rlike(_BARE_FRACTION), _NUMBER)).bitwiseOR(flag(c == n, _BARE))
    number = (
        F.when(~F.ascii(c).between(ord(" "), ord("9")), F.lit(0))
        .when(c.rlike(_BARE_LONG), F.lit(_NUMBER + _LONG + _WIDE + _BARE))
        .when(c.rlike(_BARE_FRACTION), F.lit(_NUMBER + _BARE))
        .when(c.rlike(_NO_NUMBER), F.lit(0))
        .otherwise(rest)
    )
    boolean = flag(c.isin("True", "TRUE", "true", "False", "FALSE", "false"), _BOOLEAN)
    return number.bitwiseOR(boolean).bitwiseOR(flag(maybe_date(c), _DATE))


def kind_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values of each kind the text columns hold, NULLs left out: at (the column), kind,
    shape (of what is written like a date), valid (a date of a usual shape), n. The values stand one below the other, so that the code of the tests is there once, whatever
    the width: code that repeats them for each column grows too long for the JVM to compile."""
    cells = F.array(*(F.struct(F.lit(i).alias("at"), _q(n).alias("text")) for i, n in enumerate(columns)))
    values = df.select(F.inline(cells)).where(F.col("text").isNotNull())
    c = F.col("text")
    shaped = values.select("at", "text", F.when(maybe_date(c), date_shape(c)).alias("shape"))
    # an operator of its own, so a method of its own, below the size that the JVM compiles
    dated = shaped.select(F.inline(F.array(F.struct("at", "text", "shape", usual_date(c, F.col("shape")).alias("valid")))))
    told = dated.select("at", text_kind(c).alias("kind"), "shape", "valid")
    return told.groupBy("at", "kind", "shape", "valid").agg(F.count(F.lit(1)).alias("n"))


def promotion_plan(df: DataFrame, dayfirst: bool | None = None, lenient: float | None = None, failures: dict[str, int] | None = None) -> Promotion:
    """Target type per text column: ``boolean``, ``timestamp_ntz``, ``long``, ``decimal(38,0)``,
    ``double`` or ``string`` (unchanged). One aggregate over the text columns, and one more job
    over those whose every value may be a date, unless all are written in a usual way.

    A column is promoted only when *every* non-NULL value passes: ``true``/``false``
    words (as the pandas reader) -> boolean; a valid date in an accepted shape -> timestamp;
    a number once ``, $ %`` and spaces are removed -> long when all are whole and fit one,
    decimal when all are whole and some are wider, text when a whole one is wider than that
    or stands among fractions without fitting a long, else double. Everything else stays
    text, untouched.

    Whether the day or the month comes first is decided for each column by the values that
    are valid dates in each order (a tie is month first); ``dayfirst`` settles it for all.
    ``lenient`` is the share of a column's values that must be dates for the rest to become
    NULL; ``failures`` then receives how many that were, per column.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = Promotion()
    out.formats, out.bare = {}, set()
    if not text:
        return out
    kinds: dict[str, dict[int, int]] = {n: {} for n in text}
    shapes: dict[str, dict[str, tuple[int, int]]] = {n: {} for n in text}
    for r in kind_counts(df, text).collect():
        n, k, x = text[r["at"]], r["kind"], r["shape"]
        kinds[n][k] = kinds[n].get(k, 0) + r["n"]
        if x is not None:
            count, valid = shapes[n].get(x, (0, 0))
            shapes[n][x] = count + r["n"], valid + (r["n"] if r["valid"] else 0)
    share = 1.0 if lenient is None else min(lenient, 1.0)
    total = {n: sum(kinds[n].values()) for n in text}
    dated = {n: sum(v for k, v in kinds[n].items() if k & _DATE) for n in text}
    maybe = [n for n in text if dated[n] and dated[n] >= share * total[n]]
    formats = column_formats(df, maybe, dayfirst, shapes)
    for n in text:
        count, dates = total[n], formats[n].valid if n in formats else 0
        every, some = reduce(and_, kinds[n], -1 if kinds[n] else 0), reduce(or_, kinds[n], 0)
        if every & _BOOLEAN:
            out[n] = "boolean"
        elif count and dates == count:
            out[n] = "timestamp_ntz"
        elif every & _LONG:
            out[n] = "long"
        elif every & _WIDE:
            out[n] = "decimal(38,0)"
        elif every & _NUMBER and not some & _BIG:
            out[n] = "double"
        elif lenient is not None and dates and dates >= lenient * count:
            out[n] = "timestamp_ntz"
            if failures is not None:
                failures[n] = count - dates
        else:
            out[n] = "string"
        if out[n] == "timestamp_ntz":
            out.formats[n] = formats[n]
        if every & _BARE:
            out.bare.add(n)
    return out


def apply_promotion(df: DataFrame, plan: dict[str, str], dayfirst: bool | None = None) -> DataFrame:
    """The decided types. Dates whose formats the plan holds go by them, others by the
    general parser; numbers that the plan knows to be bare are cast as they stand."""
    formats, bare = getattr(plan, "formats", {}), getattr(plan, "bare", ())

    def number(n: str, to: str, **how) -> Column:
        return _q(n).try_cast(to) if n in bare else parse_number(_q(n), **how)

    typed = {
        "boolean": lambda n: F.lower(_q(n)) == F.lit("true"),
        "timestamp_ntz": lambda n: _q(n) if n in formats else parse_datetime(_q(n), bool(dayfirst)),
        "long": lambda n: number(n, "long", integral=True),
        "decimal(38,0)": lambda n: number(n, "decimal(38,0)", wide=True),
        "double": lambda n: number(n, "double"),
        "string": _q,
    }
    return with_dates(df.select(*(typed[plan.get(n, "string")](n).alias(n) for n in df.columns)), formats)


def promote_types(df: DataFrame, dayfirst: bool | None = None, lenient: float | None = None, failures: dict[str, int] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """P2 + P3: evidence, then casts. Returns the typed frame and the decisions."""
    plan = promotion_plan(df, dayfirst, lenient, failures)
    return apply_promotion(df, plan, dayfirst), plan


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows that are NULL in every column."""
    return df.dropna(how="all")


def empty_columns(df: DataFrame) -> list[str]:
    """Columns with no value at all (one aggregate)."""
    if not df.columns:
        return []
    r = evidence(df, [F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return [c for i, c in enumerate(df.columns) if r[f"c{i}"] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """P5: drop columns that are NULL everywhere."""
    gone = set(empty_columns(df))
    return df.select(*[_q(c) for c in df.columns if c not in gone]) if gone else df


def display_prep(df: DataFrame) -> DataFrame:
    """P6-P9 (+P5): the dashboard's text preparation, literally.

    * text columns named like a date: parsed, rendered ``yyyy-MM-dd HH:mm:ss``, failures ``''``;
    * other text: ``nan``/``None``/NULL -> ``''``; then, when more than half of *all rows*
      read as numbers, the column becomes double with the rest 0;
    * date/time columns: rendered the same way, NULL -> ``''``;
    * finally columns NULL everywhere are dropped; after the steps above only non-text
      columns can still be, so an all-missing text column stays as ``''``.

    The majority and emptiness tests are one aggregate; the formats of the dates are looked up
    as in :mod:`quarry.functions.dates`.
    """
    fields = df.schema.fields

    def is_text(f):
        return isinstance(f.dataType, T.StringType)

    def is_time(f):
        return isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))

    def date_named(f):
        return any(h in f.name.lower() for h in DATE_NAME_HINTS)

    def blank(c: Column) -> Column:
        return F.when(c.isNull() | c.isin(DISPLAY_NULL_TEXT), F.lit("")).otherwise(c)

    text_plain = [f.name for f in fields if is_text(f) and not date_named(f)]
    others = [f.name for f in fields if not is_text(f) and not is_time(f)]
    r = evidence(df, [
        F.count(F.lit(1)).alias("rows"),
        *(F.count(lenient_double(blank(_q(n)))).alias(f"n{i}") for i, n in enumerate(text_plain)),
        *(F.count(_q(n)).alias(f"o{i}") for i, n in enumerate(others)),
    ])
    rows = r["rows"]
    dates = column_formats(df, [f.name for f in fields if is_text(f) and date_named(f)])
    numeric_major = {n for i, n in enumerate(text_plain) if r[f"n{i}"] > rows * 0.5}
    empty = {n for i, n in enumerate(others) if r[f"o{i}"] == 0}
    cols = []
    for f in fields:
        c = _q(f.name)
        if f.name in empty:
            continue
        if is_text(f) and date_named(f):
            e = F.coalesce(F.date_format(parsed(c, shape(c), dates[f.name]), "yyyy-MM-dd HH:mm:ss"), F.lit(""))
        elif is_text(f):
            e = F.coalesce(lenient_double(blank(c)), F.lit(0.0)) if f.name in numeric_major else blank(c)
        elif is_time(f):
            e = F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
        else:
            e = c
        cols.append(e.alias(f.name))
    return df.select(*cols)

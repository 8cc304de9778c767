"""Date parsing by a dictionary of text shapes.

A text's shape has 9 for each digit and a for each letter, the rest as it stands:
``12/1/2010 8:26`` is ``99/9/9999 9:99``. A column of dates has few shapes, whatever its
length. :func:`column_formats` counts them, pre-aggregated, in one job over all columns asked
for; only shapes that some accepted way of writing a date has come back to the driver, at most
some thousands by the grammar below. Each becomes a layout, the places of its fields, and
:func:`parsed` reads a value's fields from the places of its own shape, so a value's text is
looked at once and no pattern is matched. A column with more than ``MOST_SHAPES`` date shapes
is parsed by the one general expression instead (:func:`quarry.functions.parse.parse_datetime`),
with the same result.

The order of day and month in all-number dates is decided per column: both orders are counted
side by side over the whole column, and day first is taken only when it makes more values valid
dates (so a tie is month first, the order of the reference's parser).
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.parse import parse_datetime

#: Date shapes of a column that are compiled; a column with more goes by the general parser.
MOST_SHAPES = 64
#: Lengths that an accepted date can have.
SHORTEST, LONGEST = 6, 45

_DIGITS, _LETTERS = string.digits, string.ascii_letters
_CLOCK = r"(?<hour>9{1,2}):(?<minute>99)(:(?<second>99(\.9{1,9})?))?"
_TIME = rf"( {_CLOCK}( ?(?<noon>aa))?)?"
#: The accepted shapes: ISO dates and date-times; year first with slashes; numbers with one
#: separator and a year of four digits, or of two with slashes; English month names.
_SHAPES = (
    rf"^(?<year>9999)-(?<month>99)-(?<day>99)((?<t>[ a]){_CLOCK}( ?((?<zulu>a)|[+-]99(:?99)?))?)?$",
    rf"^(?<year>9999)/(?<month>9{{1,2}})/(?<day>9{{1,2}}){_TIME}$",
    rf"^(?<first>9{{1,2}})(?<sep>[/-])(?<next>9{{1,2}})\k<sep>(?<year>9999){_TIME}$",
    rf"^(?<first>9{{1,2}})/(?<next>9{{1,2}})/(?<short>99){_TIME}$",
    rf"^(?<name>a{{3,9}})\.? (?<day>9{{1,2}}),? (?<year>9999){_TIME}$",
    rf"^(?<day>9{{1,2}})[ -](?<name>a{{3,9}})\.?[ -](?<year>9999){_TIME}$",
)
_COMPILED = [re.compile(p.replace("(?<", "(?P<").replace(r"\k<sep>", "(?P=sep)")) for p in _SHAPES]
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: English month names and their usual short forms.
_NAMES = {w: i for i, m in enumerate(_MONTHS, 1) for w in (m, m[:3], *(["sept"] if i == 9 else []))}
#: Two-digit years from here on are of the last century, as date parsers commonly have it.
_PIVOT = 69


def _trimmed(text: Column) -> Column:
    return F.trim(text)


def maybe_date(text: Column) -> Column:
    """A cheap necessary test: length, a separator, a digit or letter in front."""
    t = _trimmed(text)
    separated = (F.instr(t, "-") > 0) | (F.instr(t, "/") > 0) | (F.instr(t, " ") > 0)
    return F.length(t).between(SHORTEST, LONGEST) & separated


#: The usual shapes, each the beginning of the longest, and the texts that have them.
_LONGEST_USUAL = "9999-99-99 99:99:99.999999999"
_USUAL = r"9999-99-99(?: 99:99:99(?:\.9{1,9})?)?"
_USUAL_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?: [0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?)?\z"


def shape(text: Column) -> Column:
    """The shape of a text that may be a date, else NULL. For the usual ones it is known by one
    pattern and the length, others are translated character by character."""
    t = _trimmed(text)
    usual = F.substring(F.lit(_LONGEST_USUAL), F.lit(1), F.length(t))
    return F.when(t.rlike(_USUAL_TEXT), usual).when(F.length(t).between(SHORTEST, LONGEST), F.translate(t, _DIGITS + _LETTERS, "9" * 10 + "a" * 52))


def date_shape(text: Column) -> Column:
    """The shape of a text that some accepted way of writing a date has, else NULL."""
    s = shape(text)
    return F.when(reduce(or_, (s.rlike(p) for p in _SHAPES)), s)


@dataclass(frozen=True)
class Layout:
    """Where the fields of a date shape stand: name -> (first place from 1, length)."""

    shape: str
    fields: dict[str, tuple[int, int]]

    @property
    def ordered(self) -> bool:
        """Whether the shape itself says which number is the month."""
        return "first" not in self.fields

    def value(self, text: Column, dayfirst: bool) -> Column:
        """The timestamp of a text of this shape; NULL when it is no valid date."""
        t = _trimmed(text)

        def part(name: str) -> Column:
            place, size = self.fields[name]
            return F.substring(t, place, size)

        def number(name: str) -> Column:
            # try_cast: safe even where an optimizer evaluates it outside its shape
            return part(name).try_cast("int")

        if "first" in self.fields:
            day, month = ("first", "next") if dayfirst else ("next", "first")
            day, month = number(day), number(month)
        elif "name" in self.fields:
            size = self.fields["name"][1]
            word = F.lower(part("name"))
            known = [(w, m) for w, m in _NAMES.items() if len(w) == size]
            month = reduce(lambda e, wm: F.when(word == wm[0], F.lit(wm[1])).otherwise(e), known, F.lit(None).cast("int"))
            day = number("day")
        else:
            day, month = number("day"), number("month")
        if "short" in self.fields:
            short = number("short")
            year = F.when(short >= _PIVOT, short + 1900).otherwise(short + 2000)
        else:
            year = number("year")
        hour = minute = F.lit(0)
        second = F.lit(0).cast("decimal(16,6)")
        sound = F.lit(True)
        if "hour" in self.fields:
            hour, minute = number("hour"), number("minute")
        if "second" in self.fields:
            place, size = self.fields["second"]
            second = F.substring(t, place, min(size, 9)).try_cast("decimal(16,6)")  # microseconds
            sound = second < 60
        if "noon" in self.fields:
            noon = F.upper(part("noon"))
            sound = sound & noon.isin("AM", "PM") & hour.between(1, 12)
            hour = hour % 12 + F.when(noon == "PM", F.lit(12)).otherwise(F.lit(0))
        for name, letter in (("t", "T"), ("zulu", "Z")):
            if name in self.fields and self.shape[self.fields[name][0] - 1] == "a":
                sound = sound & (part(name) == letter)
        return F.when(sound, F.try_make_timestamp_ntz(year, month, day, hour, minute, second))


def layout(text_shape: str) -> Layout | None:
    """The layout of a shape, None when no date is written so."""
    for p in _COMPILED:
        m = p.match(text_shape)
        if m:
            return Layout(text_shape, {n: (m.start(n) + 1, m.end(n) - m.start(n)) for n, v in m.groupdict().items() if v is not None})
    return None


def usual_date(text: Column, text_shape: Column) -> Column:
    """Whether a text of a usual shape is a valid date, in either order of day and month; NULL for
    other shapes. The longest layout reads the seconds to the text's end, so it fits all times."""
    day, moment = layout(_LONGEST_USUAL[:10]), layout(_LONGEST_USUAL)
    return F.when(text_shape == day.shape, day.value(text, False).isNotNull()).when(
        text_shape.rlike(f"^{_USUAL}\\z"), moment.value(text, False).isNotNull())


@dataclass
class Formats:
    """How the dates of one column are written."""

    layouts: list[Layout] | None  # None: too many, by the general parser
    shaped: int = 0  # values with the shape of a date
    dayfirst: bool = False
    valid: int = 0  # values that are dates in that order

    @property
    def ordered(self) -> bool:
        return self.layouts is not None and all(x.ordered for x in self.layouts)


def parsed(text: Column, text_shape: Column, formats: Formats, dayfirst: bool | None = None) -> Column:
    """The timestamp (without a zone) of a text whose shape is at hand; NULL when it is none."""
    dayfirst = formats.dayfirst if dayfirst is None else dayfirst
    if formats.layouts is None:
        return parse_datetime(text, dayfirst)
    none = F.lit(None).cast("timestamp_ntz")
    out = none
    for x in reversed(formats.layouts):
        out = F.when(text_shape == x.shape, x.value(text, dayfirst)).otherwise(out)
    return out


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _with_shapes(df: DataFrame, columns: list[str], keep: list[Column]) -> DataFrame:
    return df.select(*keep, *(shape(_q(c)).alias(f"__shape_{i}") for i, c in enumerate(columns)))


def column_formats(
    df: DataFrame, columns: list[str], dayfirst: bool | None = None, counted: dict[str, dict[str, tuple[int, int]]] | None = None
) -> dict[str, Formats]:
    """How each text column writes its dates: one job for the shapes of all columns and, when a
    column's order of day and month is open or its dates must be counted, one for the counts.
    ``dayfirst`` settles the order instead. ``counted`` has for each column the date shapes of all
    its values, when they were counted before, with the values and the valid usual dates of each:
    then the first job is not needed, nor the second for columns of usual shapes only."""
    if not columns:
        return {}
    if counted is None:
        cells = F.array(*(F.struct(F.lit(i).alias("at"), shape(_q(c)).alias("shape")) for i, c in enumerate(columns)))
        seen = df.select(F.inline(cells)).where(F.col("shape").isNotNull()).groupBy("at", "shape").agg(F.count("*").alias("n"))
        found = seen.where(reduce(or_, (F.col("shape").rlike(p) for p in _SHAPES))).collect()
        shapes = {c: {r["shape"]: r["n"] for r in found if r["at"] == i} for i, c in enumerate(columns)}
    else:
        shapes = {c: {x: n for x, (n, _) in counted[c].items()} for c in columns}
    out = {}
    for c in columns:
        layouts = [x for x in (layout(x) for x, _ in sorted(shapes[c].items(), key=lambda x: (-x[1], x[0]))) if x]
        out[c] = Formats(layouts if len(layouts) <= MOST_SHAPES else None, sum(shapes[c].values()), bool(dayfirst))
    known = {c for c in columns if counted is not None and all(re.fullmatch(_USUAL, x) for x in shapes[c])}
    for c in known:
        out[c].valid = sum(valid for _, valid in counted[c].values())
    some = [c for c in columns if out[c].shaped and c not in known]
    if some:
        at = {c: i for i, c in enumerate(some)}
        counts = [
            F.count(parsed(_q(c), F.col(f"__shape_{at[c]}"), out[c], order)).alias(f"n{int(order)}_{at[c]}")
            for c in some
            for order in ((False, True) if dayfirst is None and not out[c].ordered else (bool(dayfirst),))
        ]
        r = _with_shapes(df, some, [_q(c) for c in some]).agg(*counts).first().asDict()
        for c in some:
            month, day = r.get(f"n0_{at[c]}"), r.get(f"n1_{at[c]}")
            if dayfirst is None:
                out[c].dayfirst = day is not None and day > month
            out[c].valid = day if out[c].dayfirst else month
    return out


def with_dates(df: DataFrame, formats: dict[str, Formats], convert=lambda c: c) -> DataFrame:
    """The frame with its named text columns parsed (in place), each value's shape taken once."""
    if not formats:
        return df
    names = list(formats)
    shaped = _with_shapes(df, names, [_q(c) for c in df.columns])
    at = {c: i for i, c in enumerate(names)}
    return shaped.select(*(
        convert(parsed(_q(c), F.col(f"__shape_{at[c]}"), formats[c])).alias(c) if c in at else _q(c) for c in df.columns
    ))


def date_column(df: DataFrame, column: str, dayfirst: bool | None = None) -> Column:
    """A text column as timestamps, for use over ``df``: its formats are looked up now."""
    c = _q(column)
    return parsed(c, shape(c), column_formats(df, [column], dayfirst)[column])

"""Lenient, shape-guarded parsers as Column expressions.

A value is parsed only when its text has the shape of a known format, so that no
bare year or number turns into a date, and no '5d' into a number. Values that have
the right shape but are not valid (``2024-02-30``) become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.tokens import NA_TOKENS, NUMERIC_NOISE

# Accepted shapes, one pattern so a single match guards the parse: ISO date or date-time with
# any fraction and an optional offset; year first with slashes; day and month as numbers with
# slashes or dashes (month first unless ``dayfirst`` is asked for) and a year of four digits,
# or of two with slashes; English month names. Times may be 12-hour with AM / PM.
_TIME = r" \d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?[AaPp][Mm])?"
_ANY_DATE = (
    r"^(\d{4}-\d{2}-\d{2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|[+-]\d{2}(:?\d{2})?))?)?"
    rf"|\d{{4}}/\d{{1,2}}/\d{{1,2}}({_TIME})?"
    rf"|\d{{1,2}}(?<sep>[/-])\d{{1,2}}\k<sep>\d{{4}}({_TIME})?"
    rf"|\d{{1,2}}/\d{{1,2}}/\d{{2}}({_TIME})?"
    rf"|[A-Za-z]{{3,9}}\.? \d{{1,2}},? \d{{4}}({_TIME})?"
    rf"|\d{{1,2}}[ -][A-Za-z]{{3,9}}\.?[ -]\d{{4}}({_TIME})?)$"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_NAME = r"^(?i)(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
#: Two-digit years from here on are of the last century, as date parsers commonly have it.
_PIVOT = 69


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_tokens(col, tokens: list[str] | None = None) -> Column:
    """The value, or NULL when it is one of the missing-value tokens."""
    c = _c(col)
    toks = NA_TOKENS if tokens is None else tokens
    longest = max((len(t.encode()) for t in toks), default=0)
    return F.when((F.octet_length(c) <= longest) & c.isin(toks), F.lit(None).cast("string")).otherwise(c)


def datetime_shape(col) -> Column:
    """True when the trimmed text has one of the accepted date shapes."""
    t = F.trim(_c(col))
    return (F.length(t) >= 6) & t.rlike(_ANY_DATE)


def parse_datetime(col, dayfirst: bool = False) -> Column:
    """Text to ``timestamp_ntz``; NULL unless the shape matches and the value is valid.

    No time zone is involved: an offset is dropped and the wall-clock time stays as written.
    ISO forms go through ``try_cast``; the others are split once into their fields and built
    with ``try_make_timestamp_ntz`` (month first unless ``dayfirst``), so an impossible date
    is NULL.
    """
    t = F.trim(_c(col))
    iso_like = t.rlike(r"^\d{4}-")
    iso = F.regexp_replace(t, r"(?<=:\d{2}|\.\d{1,9}) ?(Z|[+-]\d{2}(:?\d{2})?)$", "").try_cast("timestamp_ntz")
    parts = F.split(t, r"[^0-9A-Za-z.]+|\. ")

    def number(i: int) -> Column:
        # try_cast: safe even if an optimizer evaluates this outside its shape guard
        return F.get(parts, i).try_cast("int")

    def month_name(i: int) -> Column:
        name = F.get(parts, i)
        at = F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3)))
        return F.when(name.rlike(_MONTH_NAME), ((at + 2) / 3).cast("int"))

    first_year, first_name, second_name = (F.get(parts, i).rlike(p) for i, p in ((0, r"^\d{4}$"), (0, "^[A-Za-z]"), (1, "^[A-Za-z]")))
    a, b, c = number(0), number(1), number(2)
    short = F.length(F.get(parts, 2)) == 2
    year = F.when(first_year, a).when(short, F.when(c >= _PIVOT, c + 1900).otherwise(c + 2000)).otherwise(c)
    month = F.when(first_year, b).when(first_name, month_name(0)).when(second_name, month_name(1)).otherwise(b if dayfirst else a)
    day = F.when(first_year, c).when(first_name, b).when(second_name, a).otherwise(a if dayfirst else b)
    # "26AM" and "26 AM" alike
    tail = F.upper(F.right(t, F.lit(2)))
    hour, noon = number(3), tail.isin("AM", "PM")
    minute = F.regexp_extract(F.get(parts, 4), r"^(\d+)", 1).try_cast("int")
    second = F.regexp_extract(F.get(parts, 5), r"^([0-9.]+)", 1).try_cast("decimal(16,6)")
    hour = F.when(~noon, hour).when(hour.between(1, 12), hour % 12 + F.when(tail == "PM", 12).otherwise(0))
    timed = F.size(parts) > 3
    zero = F.lit(0)
    other = F.try_make_timestamp_ntz(
        year, month, day, F.when(timed, hour).otherwise(zero), F.when(timed, minute).otherwise(zero), F.coalesce(second, zero.cast("decimal(16,6)"))
    )
    # cheap prefilter (length, a separator) before the one pattern match
    maybe = (F.length(t) >= 6) & ((F.instr(t, "-") > 0) | (F.instr(t, "/") > 0) | (F.instr(t, " ") > 0))
    return F.when(maybe & t.rlike(_ANY_DATE), F.when(iso_like, iso).otherwise(other))


def number_text(col) -> Column:
    """The text with thousands separators, currency and percent signs and spaces removed."""
    return F.regexp_replace(_c(col), f"[{NUMERIC_NOISE} ]", "")


_DIGITS = "0123456789"
_SIGNS = ("", "+", "-")
#: What is left of a plain decimal number without digits and points.
_NUMBER_REST = [a + b for a in _SIGNS for b in ("", *(e + s for e in "eE" for s in _SIGNS))]


def _whole(n: Column) -> Column:
    """Digits with at most a sign in front. Tested on what is left without the digits, so that
    texts such as ``05-01-2024`` do not get as far as a cast that fails by exception."""
    rest = F.translate(n, _DIGITS, "")
    return (F.length(n) > F.length(rest)) & ((rest == "") | (rest.isin("+", "-") & F.startswith(n, rest)))


def is_number_text(col) -> Column:
    """A plain decimal number once ``, $ %`` and spaces are removed: only digits, sign, point
    and exponent characters, arranged so that a double cast succeeds. Suffixes such as
    ``5d`` / ``3f``, ``inf`` / ``NaN`` and hex forms are excluded by the character set."""
    n = number_text(col)
    return (F.length(n) > 0) & F.translate(n, _DIGITS + ".", "").isin(_NUMBER_REST) & n.try_cast("double").isNotNull()


def is_integer_text(col) -> Column:
    """A whole number that fits a long."""
    n = number_text(col)
    return _whole(n) & n.try_cast("long").isNotNull()


def is_wide_integer_text(col) -> Column:
    """A whole number of any size up to 38 digits."""
    n = number_text(col)
    return _whole(n) & n.try_cast("decimal(38,0)").isNotNull()


def is_whole_text(col) -> Column:
    """A whole number, however long: as a double it might lose digits."""
    return _whole(number_text(col))


def parse_number(col, integral: bool = False, wide: bool = False) -> Column:
    """Cleaned numeric text to long (``integral``), decimal(38,0) (``wide``) or double; NULL
    when it is not a number."""
    t = number_text(col)
    if wide:
        return F.when(is_wide_integer_text(col), t.try_cast("decimal(38,0)"))
    if integral:
        return F.when(is_integer_text(col), t.try_cast("long"))
    return F.when(is_number_text(col), t.try_cast("double"))


def lenient_double(col) -> Column:
    """The value as a double the way a plain numeric cast reads it; NULL when it is not one."""
    t = F.trim(_c(col))
    return F.when((F.length(t) > 0) & F.translate(t, _DIGITS + ".", "").isin(_NUMBER_REST), t.try_cast("double"))

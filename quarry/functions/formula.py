"""KPI formula compiler (U1): a pandas-style expression string to Spark aggregates.

Plans carry KPI formulas written against a pandas frame named ``df``, such as
``df['amount'].sum()``, ``(df['qty'] * df['price']).sum()``, ``len(df[df['x'] > 3])``,
``(df['status'] == 'returned').mean()`` or ``df.groupby('channel')['amount'].sum()``.
The text is parsed with :mod:`ast` and only a whitelist of forms is accepted; each form
maps onto a built-in aggregate so the whole KPI row is one ``df.agg(...)``. Nothing is
evaluated in Python and no UDF is involved. Column names go through
:func:`quarry.functions.names.resolve_column`. Anything else raises
:class:`FormulaError`, which plan execution reports as ``unsupported``.

pandas semantics kept: ``sum`` of nothing is 0; ``mean``/``min``/``max`` of nothing is
NULL (pandas NaN); ``std``/``var`` are the sample versions, ``np.std``/``np.var`` the
population ones; comparisons against a missing value are False (``!=`` is True), so a
boolean mask has no NULLs; ``len`` counts rows, ``count`` non-null values; group keys
that are NULL are dropped.
"""

from __future__ import annotations

import ast
import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.names import resolve_column
from quarry.functions.parse import parse_datetime


class FormulaError(ValueError):
    """The formula uses a form outside the supported grammar."""


@dataclass
class _Frame:
    mask: Column | None


@dataclass
class _Series:
    expr: Column
    mask: Column | None
    dtype: T.DataType
    name: str | None = None  # of a plain column


@dataclass
class _Agg:
    expr: Column
    dtype: T.DataType | None = None  # of a value that is no number


@dataclass
class _Accessor:
    """``.dt`` or ``.str`` of a series."""

    series: _Series
    kind: str


@dataclass
class _At:
    """``df.loc`` or ``df.iloc``, and the label that ``idxmax`` / ``idxmin`` gives."""

    mask: Column | None


@dataclass
class _Label:
    """The row at which a series is largest or smallest."""

    series: _Series
    largest: bool


@dataclass
class _Top:
    """The ``n`` largest (smallest) values of a series."""

    series: _Series
    n: int
    largest: bool


@dataclass
class _Distinct:
    """A frame with the first row of each key; first by the values of its columns."""

    keys: list[str]
    mask: Column | None


@dataclass
class _FirstSeries:
    """A column of a frame of first rows."""

    frame: _Distinct
    series: _Series


@dataclass
class _Running:
    """An ordered series: a running or moving function of row values."""

    series: _Series
    fn: str
    n: int = 1


@dataclass
class _Window:
    series: _Series
    n: int


@dataclass
class _Reduced:
    """A single value that takes a plan of its own: see ``CompiledFormula``."""

    kind: str
    series: _Series
    outer: str | None
    n: int = 1
    largest: bool = True
    fn: str | None = None
    value: Column | None = None
    key: Column | None = None


@dataclass
class _Const:
    value: object


@dataclass
class _GroupBy:
    key: Column
    mask: Column | None
    period: str | None = None  # of a resampling


@dataclass
class _GroupSeries:
    key: Column
    expr: Column
    mask: Column | None
    dtype: T.DataType
    period: str | None = None


@dataclass
class _Repeats:
    """Rows that repeat an earlier one, as one aggregate."""

    total: Column


@dataclass
class _Unique:
    """The distinct values of a series, a missing one included."""

    series: _Series


@dataclass
class _Grouped:
    """One aggregate per key; reduced again it is a single value."""

    key: Column
    expr: Column
    mask: Column | None
    median: bool = False
    period: str | None = None
    empty: float | None = None  # the value of a period without rows


@dataclass
class _Sizes:
    """``value_counts().iloc``: the counts from the largest on."""

    grouped: _Grouped


@dataclass
class _Keys:
    """``mode()`` and ``value_counts().index``: the values, the most frequent first."""

    grouped: _Grouped


@dataclass
class _Nested:
    """A reduction over one aggregate per key."""

    inner: _Grouped
    outer: str


@dataclass
class CompiledFormula:
    """``kind`` is ``scalar`` (``value`` is one aggregate), ``grouped`` (``key`` + aggregate
    ``value``), ``grouped_median`` (``key`` + the row expression whose median is wanted),
    ``nested`` (like grouped, its values reduced by ``outer``), ``top`` (the ``n`` first values
    by size, reduced by ``outer``), ``first`` (one row per key, then the aggregate ``value``)
    or ``running`` (a function of ordered rows, reduced by ``outer``). ``text``: the value is
    no number."""

    kind: str
    value: Column
    key: Column | None = None
    mask: Column | None = None
    outer: str | None = None
    text: bool = False
    n: int = 1
    largest: bool = True
    fn: str | None = None
    period: str | None = None
    empty: float | None = None


_SERIES_AGGS = {"sum", "mean", "min", "max", "count", "nunique", "median", "std", "var", "skew", "kurt", "kurtosis", "prod", "sem"}
#: Reductions of a grouped or running result.
_OUTER = {"sum", "mean", "min", "max", "count", "std", "var"}
_RUNNING = {"cumsum", "cummax", "cummin", "diff", "pct_change", "shift"}
#: Parts of a time: pandas counts weekdays from Monday, 0.
_TIME_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
    "dayofyear": F.dayofyear, "day_of_year": F.dayofyear, "dayofweek": F.weekday, "day_of_week": F.weekday, "weekday": F.weekday,
}
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_INTERVAL = T.DayTimeIntervalType()
#: Periods of ``resample``: unit to cut to, step, and whether the label is the period's last day.
PERIODS = {
    **dict.fromkeys(("D",), ("day", "1 day", False)), **dict.fromkeys(("W",), ("week", "7 days", True)), **dict.fromkeys(("H", "h"), ("hour", "1 hour", False)),
    **dict.fromkeys(("M", "ME"), ("month", "1 month", True)), **dict.fromkeys(("MS",), ("month", "1 month", False)),
    **dict.fromkeys(("Q", "QE"), ("quarter", "3 months", True)), **dict.fromkeys(("Y", "YE", "A"), ("year", "12 months", True)),
}
_BUILTIN_AGGS = {"sum": "sum", "max": "max", "min": "min", "mean": "mean", "len": "len"}
_NUMPY_AGGS = {"mean": "mean", "sum": "sum", "max": "max", "min": "min", "median": "median",
               "std": "std_pop", "var": "var_pop", "average": "mean", "nanmean": "mean",
               "nansum": "sum", "nanmax": "max", "nanmin": "min", "nanmedian": "median"}
_CMP = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


def _and(a: Column | None, b: Column | None) -> Column | None:
    if a is None:
        return b
    if b is None:
        return a
    return a & b


def _seconds(later: Column, earlier: Column) -> Column:
    """The time between two wall-clock times, in seconds."""
    gap = later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), gap).cast("double")
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def reduce_values(fn: str, value: Column) -> Column:
    """A reduction of already aggregated values."""
    return _aggregate(fn, value, None, T.DoubleType())


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def _aggregate(fn: str, expr: Column, mask: Column | None, dtype: T.DataType) -> Column:
    """One pandas reduction as a Spark aggregate over the masked values."""
    if fn not in {"min", "max", "count", "nunique"} and not _is_numeric(dtype):
        raise FormulaError(f"{fn} needs a numeric column")
    if isinstance(dtype, T.BooleanType):
        expr = expr.cast("long")
    if isinstance(dtype, T.DecimalType) and fn in {"mean", "median", "std", "var", "std_pop", "var_pop"}:
        expr = expr.cast("double")
    x = expr if mask is None else F.when(mask, expr)
    if fn == "sum":
        if isinstance(dtype, T.IntegralType):
            x = x.cast("decimal(19,0)")  # no total overflows
        if isinstance(dtype, T.DecimalType):
            # a total beyond 38 digits goes on as a double
            return F.coalesce(F.try_sum(x).cast("double"), F.sum(x.cast("double")), F.lit(0.0))
        return F.coalesce(F.sum(x), F.lit(0))
    if fn == "mean":
        return F.avg(x)
    if fn == "min":
        return F.min(x)
    if fn == "max":
        return F.max(x)
    if fn == "count":
        return F.count(x)
    if fn == "nunique":
        return F.count_distinct(x)
    if fn == "median":
        return F.median(x)
    if fn == "std":
        return F.stddev_samp(x)
    if fn == "var":
        return F.var_samp(x)
    if fn == "std_pop":
        return F.stddev_pop(x)
    if fn == "var_pop":
        return F.var_pop(x)
    y = x.cast("double")
    n = F.count(x).cast("double")
    if fn == "skew":  # the sample's, as pandas gives it
        return F.when(n > 2, F.when(F.var_pop(y) > 0, F.skewness(y) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0))
    if fn in {"kurt", "kurtosis"}:
        return F.when(n > 3, F.when(F.var_pop(y) > 0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(y) + 6)).otherwise(0.0))
    if fn == "prod":
        return F.coalesce(F.product(y), F.lit(1.0))
    if fn == "sem":
        return F.stddev_samp(y) / F.sqrt(n)
    raise FormulaError(f"unsupported reduction {fn}")


_FOLD = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def _fold(op, a, b):
    """Arithmetic on two numeric literals, with no evaluation of the text."""
    if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (a, b)):
        raise FormulaError("arithmetic needs numbers")
    if isinstance(op, ast.Pow):
        try:
            return float(a) ** float(b)
        except (OverflowError, ZeroDivisionError) as e:
            raise FormulaError("a power out of range") from e
    f = _FOLD.get(type(op))
    if f is None:
        raise FormulaError("unsupported operator")
    try:
        return f(a, b)
    except ZeroDivisionError as e:
        raise FormulaError("division by zero in a literal") from e


#: Decimal digits that hold any value of a whole-number type.
_WHOLE_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19, T.BooleanType: 1}


def _digits(dtype: T.DataType) -> int | None:
    """The decimal digits of a whole number type, None for others."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision if dtype.scale == 0 else None
    return _WHOLE_DIGITS.get(type(dtype))


def _arith(op, a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> tuple[Column, T.DataType]:
    """Row arithmetic and its type. Whole numbers add and multiply as decimals wide enough for
    any result, beyond 38 digits as doubles; everything else as doubles."""
    da, db = _digits(ta), _digits(tb)
    if da and db and isinstance(op, (ast.Add, ast.Sub, ast.Mult)):
        digits = da + db if isinstance(op, ast.Mult) else max(da, db) + 1
        if digits <= 38:
            x, y = ((c.cast("int") if isinstance(t, T.BooleanType) else c).cast(f"decimal({d},0)") for c, t, d in ((a, ta, da), (b, tb, db)))
            wide = T.DecimalType(digits, 0)
            return _Compiler.arith(op, x, y).cast(wide), wide
    x, y = ((c.cast("int") if isinstance(t, T.BooleanType) else c).cast("double") for c, t in ((a, ta), (b, tb)))
    return _Compiler.arith(op, x, y), T.DoubleType()


def _row_count(mask: Column | None) -> Column:
    return F.count(F.lit(1)) if mask is None else F.count_if(mask)


#: Keyword arguments that calls may have.
_KEYWORDS = {
    "contains": {"case", "regex", "na"}, "startswith": {"na"}, "endswith": {"na"}, "resample": {"on"}, "drop_duplicates": {"subset"}, "duplicated": {"subset"}, "to_numeric": {"errors"},
    "to_datetime": {"errors", "dayfirst"}, "groupby": {"as_index", "sort", "dropna", "observed"},
}


class _Compiler:
    def __init__(self, schema: T.StructType, median_hook=None):
        self.median_hook = median_hook
        self.schema = schema
        self.columns = [f.name for f in schema.fields]
        self.types = {f.name: f.dataType for f in schema.fields}

    # -- helpers -------------------------------------------------------------
    def resolve(self, name: str) -> str:
        actual = name if name in self.types else resolve_column(name, self.columns)
        if actual is None:
            raise FormulaError(f"no column matches {name!r}")
        return actual

    def column(self, name: str, mask: Column | None) -> _Series:
        actual = self.resolve(name)
        return _Series(F.col(f"`{actual}`"), mask, self.types[actual], actual)

    def lit_or_col(self, v) -> tuple[Column, T.DataType]:
        if isinstance(v, _Series):
            return v.expr, v.dtype
        if isinstance(v, _Const):
            if isinstance(v.value, bool):
                return F.lit(v.value), T.BooleanType()
            if isinstance(v.value, int) and len(str(abs(v.value))) <= 38:
                digits = len(str(abs(v.value)))
                return F.lit(str(v.value)).cast(f"decimal({digits},0)"), T.DecimalType(digits, 0)
            if isinstance(v.value, (int, float)):
                return F.lit(float(v.value)), T.DoubleType()
            return F.lit(v.value), T.StringType()
        raise FormulaError("expected a column or a constant")

    def agg(self, fn: str, expr: Column, mask: Column | None, dtype: T.DataType) -> Column:
        """A reduction; a scalar median goes to the hook when one is given (exact, distributed)."""
        if dtype == _INTERVAL:
            dtype = T.DoubleType()
        if fn == "median" and self.median_hook is not None:
            if not _is_numeric(dtype):
                raise FormulaError("median needs a numeric column")
            e = expr.cast("long") if isinstance(dtype, T.BooleanType) else expr
            return F.lit(self.median_hook(e, mask)).cast("double")
        return _aggregate(fn, expr, mask, dtype)

    def method(self, base: _Series, name: str, args: list):
        """A row-wise method of a column, or a reduction with arguments."""
        if not all(isinstance(a, _Const) for a in args):
            raise FormulaError(f"{name}() takes constants")
        values, x = [a.value for a in args], base.expr
        truth = lambda e: _Series(e, base.mask, T.BooleanType())
        match name, values:
            case "isin", [list() as wanted]:
                return truth(F.coalesce(x.isin(wanted), F.lit(False)) if wanted else F.lit(False))
            case "isna" | "isnull", []:
                return truth(x.isNull())
            case "notna" | "notnull", []:
                return truth(x.isNotNull())
            case "between", [low, high]:
                return truth(F.coalesce(x.between(F.lit(low), F.lit(high)), F.lit(False)))
            case "fillna", [value] if value is not None:
                return _Series(F.coalesce(x, F.lit(value)), base.mask, base.dtype)
            case "round", ([] | [int()]):
                return _Series(F.bround(x, values[0] if values else 0), base.mask, base.dtype)
            case "abs", []:
                return _Series(F.abs(x), base.mask, base.dtype)
            case "unique", []:
                return _Unique(base)
            case "value_counts", []:
                return _Grouped(x, F.count(x), base.mask)
            case "mode", []:
                return _Keys(_Grouped(x, F.count(x), base.mask))
            case "quantile", [float() | int() as q] if 0 <= q <= 1:
                return self.quantile(base, q)
            case "astype", [str() as kind] if kind.rstrip("0123468") in {"int", "float", "str", "bool"}:
                to = {"int": ("long", T.LongType()), "float": ("double", T.DoubleType()), "str": ("string", T.StringType()), "bool": ("boolean", T.BooleanType())}[kind.rstrip("0123468")]
                return _Series(x.try_cast(to[0]), base.mask, to[1])
            case "idxmax" | "idxmin", []:
                return _Label(base, name == "idxmax")
            case "nlargest" | "nsmallest", ([] | [int()]) if _is_numeric(base.dtype):
                return _Top(base, values[0] if values else 5, name == "nlargest")
            case "duplicated", []:
                return self.repeats([x], base.mask)
            case "rolling", [int() as n] if n > 0:
                return _Window(base, n)
            case _, ([] | [int()]) if name in _RUNNING and _is_numeric(base.dtype):
                return _Running(base, name, values[0] if values else 1)
            case _, [] if name in _SERIES_AGGS:
                kept = base.dtype if name in {"min", "max"} or base.dtype == _INTERVAL else None
                return _Agg(self.agg(name, x, base.mask, base.dtype), None if kept is None or _is_numeric(kept) else kept)
        raise FormulaError(f"unsupported call {name}()")

    def quantile(self, base: _Series, q: float) -> _Agg:
        if self.median_hook is None or not _is_numeric(base.dtype):
            raise FormulaError("quantile needs a numeric column of a table")
        return _Agg(F.lit(self.median_hook(base.expr, base.mask, q)).cast("double"))

    def repeats(self, keys: list[Column], mask: Column | None) -> _Repeats:
        """``duplicated()`` as something to add up: rows but the first of each key; a missing
        value is a value like others. Only its sum is one aggregate."""
        key = F.struct(*keys)
        total = F.count(F.lit(1)) if mask is None else F.count_if(mask)
        return _Repeats(total - F.count_distinct(key if mask is None else F.when(mask, key)))

    def of_two(self, a: _Series, name: str, b: _Series) -> _Agg:
        """Correlation and covariance of two columns, over rows that have both."""
        if not (_is_numeric(a.dtype) and _is_numeric(b.dtype)):
            raise FormulaError(f"{name} needs numeric columns")
        mask = _and(a.mask, b.mask)
        x, y = (e.cast("double") if mask is None else F.when(mask, e.cast("double")) for e in (a.expr, b.expr))
        return _Agg({"corr": F.corr, "cov": F.covar_samp}[name](x, y))

    def accessor(self, a: _Accessor, name: str, args: list, keywords: dict) -> _Series:
        """``.str`` methods; a missing text stays missing, and is False in a test."""
        x, mask = a.series.expr, a.series.mask
        truth = lambda e: _Series(F.coalesce(e, F.lit(False)), mask, T.BooleanType())
        if a.kind == "dt":
            if name == "total_seconds" and not args and a.series.dtype == _INTERVAL:
                return _Series(x, mask, T.DoubleType())
            raise FormulaError(f"unsupported call .dt.{name}()")
        match name, args:
            case "len", []:
                return _Series(F.length(x), mask, T.IntegerType())
            case "lower" | "upper" | "strip", []:
                return _Series({"lower": F.lower, "upper": F.upper, "strip": F.trim}[name](x), mask, T.StringType())
            case "startswith" | "endswith", [str() as part]:
                return truth({"startswith": F.startswith, "endswith": F.endswith}[name](x, F.lit(part)))
            case "contains", [str() as part]:
                case, as_pattern = keywords.get("case", True), keywords.get("regex", True)
                if as_pattern:
                    return truth(x.rlike(part if case else "(?i)" + part))
                return truth(F.contains(x, F.lit(part)) if case else F.contains(F.lower(x), F.lit(part.lower())))
        raise FormulaError(f"unsupported call .str.{name}()")

    def keys(self, k, mask: Column | None) -> Column:
        """A grouping key: a column, a list of columns (joined, missing if one is), a series."""
        if isinstance(k, _Series):
            return k.expr
        if isinstance(k, _Const) and isinstance(k.value, str):
            return self.column(k.value, mask).expr
        if isinstance(k, _Const) and isinstance(k.value, list) and k.value and all(isinstance(v, str) for v in k.value):
            parts = [self.column(v, mask).expr.cast("string") for v in k.value]
            return parts[0] if len(parts) == 1 else F.concat(parts[0], *(c for p in parts[1:] for c in (F.lit(", "), p)))
        raise FormulaError("groupby takes a column, a list of columns or a series")

    # -- visitor -------------------------------------------------------------
    def visit(self, node):
        m = getattr(self, f"v_{type(node).__name__}", None)
        if m is None:
            raise FormulaError(f"unsupported syntax: {type(node).__name__}")
        return m(node)

    def v_Expression(self, node):
        return self.visit(node.body)

    def v_Name(self, node):
        if node.id == "df":
            return _Frame(None)
        if node.id in {"int", "float", "str", "bool"}:
            return _Const(node.id)  # as in astype(int)
        raise FormulaError(f"unknown name {node.id!r}")

    def v_Constant(self, node):
        if isinstance(node.value, (int, float, str, bool)) or node.value is None:
            return _Const(node.value)
        raise FormulaError("unsupported constant")

    def v_Dict(self, node):
        keys, values = ([self.visit(x) for x in part] for part in (node.keys, node.values))
        if not all(isinstance(x, _Const) for x in [*keys, *values]):
            raise FormulaError("a dict holds constants")
        return _Const({k.value: v.value for k, v in zip(keys, values)})

    def v_List(self, node):
        items = [self.visit(e) for e in node.elts]
        if not all(isinstance(i, _Label) or isinstance(i, _Const) and not isinstance(i.value, (list, dict)) for i in items):
            raise FormulaError("a list holds constants")
        return _Const([i if isinstance(i, _Label) else i.value for i in items])

    v_Tuple = v_List

    def v_UnaryOp(self, node):
        v = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            if isinstance(v, _Const) and isinstance(v.value, (int, float)):
                return _Const(-v.value)
            if isinstance(v, _Series):
                expr, dtype = _arith(ast.Sub(), F.lit(0), T.IntegerType(), v.expr, v.dtype)
                return _Series(expr, v.mask, dtype)
            if isinstance(v, _Agg):
                return _Agg(-v.expr)
        if isinstance(node.op, (ast.Invert, ast.Not)) and isinstance(v, _Series):
            return _Series(~v.expr, v.mask, T.BooleanType())
        raise FormulaError("unsupported unary operator")

    def v_Subscript(self, node):
        base = self.visit(node.value)
        key = self.visit(node.slice)
        if isinstance(base, _Frame):
            if isinstance(key, _Const) and isinstance(key.value, str):
                return self.column(key.value, base.mask)
            if isinstance(key, _Series) and isinstance(key.dtype, T.BooleanType):
                return _Frame(_and(base.mask, _and(key.mask, key.expr)))
        if isinstance(base, _GroupBy) and isinstance(key, _Const) and isinstance(key.value, str):
            s = self.column(key.value, base.mask)
            return _GroupSeries(base.key, s.expr, base.mask, s.dtype, base.period)
        if isinstance(base, _Distinct) and isinstance(key, _Const) and isinstance(key.value, str):
            s = self.column(key.value, base.mask)
            return _FirstSeries(base, s)
        if isinstance(base, _Sizes) and isinstance(key, _Const) and key.value == 0 and not isinstance(key.value, bool):
            return _Nested(base.grouped, "max")
        if isinstance(base, _Keys) and isinstance(key, _Const) and key.value == 0 and not isinstance(key.value, bool):
            return _Nested(base.grouped, "idxmax")  # ties by value
        if isinstance(base, _At) and isinstance(key, _Const) and isinstance(key.value, list) and len(key.value) == 2 and isinstance(key.value[0], _Label) and isinstance(key.value[1], str):
            label, wanted = key.value[0], self.column(key.value[1], base.mask)
            v = label.series.expr
            if not _is_numeric(label.series.dtype):
                raise FormulaError("idxmax needs a numeric column")
            mask = _and(_and(base.mask, label.series.mask), v.isNotNull())
            size = -v.cast("double") if label.largest else v.cast("double")
            # the row of the largest value, ties by the wanted value
            best = F.min(F.when(mask, F.struct(size.alias("size"), wanted.expr.alias("wanted"))))["wanted"]
            return _Agg(best, None if _is_numeric(wanted.dtype) else wanted.dtype)
        if isinstance(base, _Series) and isinstance(key, _Series) and isinstance(key.dtype, T.BooleanType):
            return _Series(base.expr, _and(base.mask, _and(key.mask, key.expr)), base.dtype)
        raise FormulaError("unsupported subscript")

    def v_Attribute(self, node):
        base = self.visit(node.value)
        if isinstance(base, _Frame) and node.attr in {"loc", "iloc"}:
            return _At(base.mask)
        if isinstance(base, _Frame) and node.attr not in {"groupby", "shape"}:
            return self.column(node.attr, base.mask)
        if isinstance(base, _Series) and node.attr == "dt" and (isinstance(base.dtype, _TIMES) or base.dtype == _INTERVAL):
            return _Accessor(base, "dt")
        if isinstance(base, _Series) and node.attr == "str" and isinstance(base.dtype, T.StringType):
            return _Accessor(base, "str")
        if isinstance(base, _Accessor) and base.kind == "dt":
            x, mask = base.series.expr, base.series.mask
            if base.series.dtype == _INTERVAL:
                if node.attr == "days":
                    return _Series(F.floor(x / 86400), mask, T.LongType())
            elif node.attr == "date":
                return _Series(F.to_date(x), mask, T.DateType())
            elif node.attr in _TIME_PARTS:
                return _Series(_TIME_PARTS[node.attr](x), mask, T.IntegerType())
        if isinstance(base, _Agg) and base.dtype == _INTERVAL and node.attr == "days":
            return _Agg(F.floor(base.expr / 86400))
        if isinstance(base, _Grouped) and node.attr in {"index", "iloc"}:
            return _Keys(base) if node.attr == "index" else _Sizes(base)
        if isinstance(base, _Keys) and node.attr == "iloc":
            return base
        raise FormulaError(f"unsupported attribute {node.attr!r}")

    def v_Compare(self, node):
        if len(node.ops) != 1:
            raise FormulaError("chained comparisons are not supported")
        left = self.visit(node.left)
        right = self.visit(node.comparators[0])
        if not isinstance(left, _Series) and not isinstance(right, _Series):
            raise FormulaError("a comparison needs a column")
        a, _ = self.lit_or_col(left)
        b, _ = self.lit_or_col(right)
        op = _CMP.get(type(node.ops[0]))
        if op is None:
            raise FormulaError("unsupported comparison")
        expr = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        # pandas: any comparison with a missing value is False, except != which is True.
        expr = F.coalesce(expr, F.lit(op == "!="))
        mask = left.mask if isinstance(left, _Series) else right.mask
        return _Series(expr, mask, T.BooleanType())

    def v_BoolOp(self, node):
        vals = [self.visit(v) for v in node.values]
        if not all(isinstance(v, _Series) and isinstance(v.dtype, T.BooleanType) for v in vals):
            raise FormulaError("'and'/'or' need boolean columns")
        expr = vals[0].expr
        for v in vals[1:]:
            expr = (expr & v.expr) if isinstance(node.op, ast.And) else (expr | v.expr)
        return _Series(expr, vals[0].mask, T.BooleanType())

    def v_BinOp(self, node):
        left = self.visit(node.left)
        right = self.visit(node.right)
        op = node.op
        if isinstance(op, (ast.BitAnd, ast.BitOr)):
            if isinstance(left, _Series) and isinstance(right, _Series):
                expr = (left.expr & right.expr) if isinstance(op, ast.BitAnd) else (left.expr | right.expr)
                return _Series(expr, _and(left.mask, right.mask), T.BooleanType())
            raise FormulaError("'&'/'|' need boolean columns")
        if isinstance(left, _Const) and isinstance(right, _Const):
            return _Const(_fold(op, left.value, right.value))
        if isinstance(left, _Series) or isinstance(right, _Series):
            if isinstance(left, _Agg) or isinstance(right, _Agg):
                raise FormulaError("row values and aggregates cannot be mixed")
            a, ta = self.lit_or_col(left)
            b, tb = self.lit_or_col(right)
            if isinstance(ta, _TIMES) and isinstance(tb, _TIMES) and isinstance(op, ast.Sub):
                return _Series(_seconds(a, b), _and(left.mask, right.mask), _INTERVAL)
            for t in (ta, tb):
                if not _is_numeric(t):
                    raise FormulaError("arithmetic needs numeric columns")
            mask = _and(left.mask if isinstance(left, _Series) else None,
                        right.mask if isinstance(right, _Series) else None)
            expr, dtype = _arith(op, a, ta, b, tb)
            return _Series(expr, mask, dtype)
        if isinstance(left, _Agg) and isinstance(right, _Agg) and isinstance(left.dtype, _TIMES) and isinstance(right.dtype, _TIMES) and isinstance(op, ast.Sub):
            return _Agg(_seconds(left.expr, right.expr), _INTERVAL)
        if any(isinstance(v, _Agg) and v.dtype is not None for v in (left, right)):
            raise FormulaError("arithmetic needs numbers")
        left, right = (_Agg(v.total) if isinstance(v, _Repeats) else v for v in (left, right))
        if isinstance(left, (_Agg, _Const)) and isinstance(right, (_Agg, _Const)):
            a, b = ((v.expr if isinstance(v, _Agg) else F.lit(v.value)).cast("double") for v in (left, right))
            return _Agg(self.arith(op, a, b))
        raise FormulaError("unsupported arithmetic")

    @staticmethod
    def arith(op, a: Column, b: Column) -> Column:
        if isinstance(op, ast.Add):
            return a + b
        if isinstance(op, ast.Sub):
            return a - b
        if isinstance(op, ast.Mult):
            return a * b
        if isinstance(op, ast.Div):
            return F.try_divide(a.cast("double"), b.cast("double"))
        if isinstance(op, ast.Pow):
            return F.pow(a, b)
        raise FormulaError("unsupported operator")

    def v_Call(self, node):
        f = node.func
        given = {}
        for k in node.keywords:
            v = self.visit(k.value)
            if k.arg is None or not isinstance(v, _Const):
                raise FormulaError("keyword arguments are constants")
            given[k.arg] = v.value
        allowed = _KEYWORDS.get(f.attr if isinstance(f, ast.Attribute) else "", set())
        if not given.keys() <= allowed:
            raise FormulaError("unsupported keyword argument")
        # Builtins and numpy functions over one argument.
        if isinstance(f, ast.Name) and f.id == "round" and len(node.args) in (1, 2):
            arg, *places = map(self.visit, node.args)
            digits = places[0].value if places and isinstance(places[0], _Const) else 0
            if isinstance(arg, _Agg) and isinstance(digits, int):
                return _Agg(F.bround(arg.expr.cast("double"), digits))
            raise FormulaError("round needs a single value")
        if isinstance(f, ast.Name) and f.id in _BUILTIN_AGGS:
            if len(node.args) != 1:
                raise FormulaError(f"{f.id} takes one argument")
            arg = self.visit(node.args[0])
            fn = _BUILTIN_AGGS[f.id]
            if fn == "len":
                if isinstance(arg, (_Frame, _Series)):
                    return _Agg(_row_count(arg.mask))
                if isinstance(arg, _Distinct):
                    key = F.struct(*(F.col(f"`{c}`") for c in arg.keys))
                    return _Agg(F.count_distinct(key if arg.mask is None else F.when(arg.mask, key)))
                if isinstance(arg, _Unique):
                    s = arg.series
                    missing = s.expr.isNull() if s.mask is None else s.mask & s.expr.isNull()
                    return _Agg(_aggregate("nunique", s.expr, s.mask, s.dtype) + F.coalesce(F.bool_or(missing), F.lit(False)).cast("long"))
                raise FormulaError("len needs a frame or column")
            if isinstance(arg, _Series):
                return _Agg(self.agg(fn, arg.expr, arg.mask, arg.dtype))
            raise FormulaError(f"{f.id} needs a column")
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in {"np", "numpy"}:
            if f.attr in {"percentile", "quantile"} and len(node.args) == 2:
                arg, q = map(self.visit, node.args)
                share = q.value / (100 if f.attr == "percentile" else 1) if isinstance(q, _Const) and isinstance(q.value, (int, float)) else -1
                if isinstance(arg, _Series) and 0 <= share <= 1:
                    return self.quantile(arg, share)
                raise FormulaError(f"{f.attr} needs a column and a rank")
            if f.attr == "where" and len(node.args) == 3:
                test, a, b = map(self.visit, node.args)
                if not (isinstance(test, _Series) and isinstance(test.dtype, T.BooleanType)):
                    raise FormulaError("where needs a test")
                (x, tx), (y, ty) = self.lit_or_col(a), self.lit_or_col(b)
                if _is_numeric(tx) != _is_numeric(ty):
                    raise FormulaError("where needs values of one kind")
                number = _is_numeric(tx) and not (_digits(tx) and _digits(ty))
                wide = T.DecimalType(max(_digits(tx) or 1, _digits(ty) or 1), 0)
                kind = T.DoubleType() if number else wide if _is_numeric(tx) else tx
                x, y = ((e.cast("int") if isinstance(t, T.BooleanType) else e).cast(kind) for e, t in ((x, tx), (y, ty)))
                return _Series(F.when(test.expr, x).otherwise(y), test.mask, kind)
            fn = _NUMPY_AGGS.get(f.attr)
            if fn is None or len(node.args) != 1:
                raise FormulaError(f"unsupported numpy call {f.attr}")
            arg = self.visit(node.args[0])
            if isinstance(arg, _Series):
                return _Agg(self.agg(fn, arg.expr, arg.mask, arg.dtype))
            raise FormulaError("numpy reductions need a column")
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in {"pd", "pandas"}:
            arg = self.visit(node.args[0]) if len(node.args) == 1 else None
            if not isinstance(arg, _Series):
                raise FormulaError(f"{f.attr} needs a column")
            if f.attr == "to_numeric":
                return _Series(arg.expr.try_cast("double"), arg.mask, T.DoubleType())
            if f.attr == "to_datetime" and isinstance(arg.dtype, T.StringType):
                return _Series(parse_datetime(arg.expr, bool(given.get("dayfirst"))), arg.mask, T.TimestampNTZType())
            if f.attr == "to_datetime" and isinstance(arg.dtype, _TIMES):
                return arg
            raise FormulaError(f"unsupported call {f.attr}")
        if isinstance(f, ast.Attribute):
            base = self.visit(f.value)
            args = [self.visit(a) for a in node.args]
            if isinstance(base, _Frame) and f.attr == "groupby" and len(args) == 1:
                return _GroupBy(self.keys(args[0], base.mask), base.mask)
            if isinstance(base, _Frame) and f.attr == "resample" and len(args) == 1 and args[0].value in PERIODS and "on" in given:
                t = self.column(given["on"], base.mask)
                if not isinstance(t.dtype, _TIMES):
                    raise FormulaError("resample needs a time")
                return _GroupBy(F.date_trunc(PERIODS[args[0].value][0], t.expr.cast("timestamp_ntz")).cast("timestamp_ntz"), base.mask, args[0].value)
            if isinstance(base, _Frame) and f.attr in {"duplicated", "drop_duplicates"}:
                subset = given.get("subset", args[0].value if len(args) == 1 and isinstance(args[0], _Const) else None)
                names = [subset] if isinstance(subset, str) else subset or self.columns
                names = [self.resolve(n) for n in names]
                if f.attr == "duplicated":
                    return self.repeats([F.col(f"`{n}`") for n in names], base.mask)
                return _Distinct(names, base.mask)
            if isinstance(base, _Repeats) and f.attr == "sum" and not args:
                return _Agg(base.total)
            if isinstance(base, _Accessor):
                if not all(isinstance(a, _Const) for a in args):
                    raise FormulaError(f"{f.attr}() takes constants")
                return self.accessor(base, f.attr, [a.value for a in args], given)
            if isinstance(base, _Series) and f.attr in {"corr", "cov"} and len(args) == 1 and isinstance(args[0], _Series):
                return self.of_two(base, f.attr, args[0])
            if isinstance(base, _Series):
                return self.method(base, f.attr, args)
            if isinstance(base, (_GroupSeries, _GroupBy)) and f.attr in {"agg", "aggregate"} and len(args) == 1 and isinstance(args[0], _Const):
                wanted = args[0].value
                if isinstance(base, _GroupBy) and isinstance(wanted, dict) and len(wanted) == 1:
                    (name, wanted), = wanted.items()
                    s = self.column(name, base.mask)
                    base = _GroupSeries(base.key, s.expr, base.mask, s.dtype, base.period)
                if isinstance(base, _GroupSeries) and isinstance(wanted, str):
                    f, args = ast.Attribute(f.value, wanted, ast.Load()), []
            if isinstance(base, _Agg) and base.dtype == _INTERVAL and f.attr == "total_seconds" and not args:
                return _Agg(base.expr)
            if args:
                raise FormulaError(f"{f.attr}() takes no arguments here")
            if isinstance(base, _GroupSeries) and f.attr == "median" and base.period is None:
                if not _is_numeric(base.dtype):
                    raise FormulaError("median needs a numeric column")
                return _Grouped(base.key, base.expr, base.mask, median=True)
            if isinstance(base, (_GroupBy, _GroupSeries)) and f.attr == "size":
                return _Grouped(base.key, F.count(F.lit(1)), base.mask, period=base.period, empty=0.0)
            if isinstance(base, _GroupSeries) and f.attr in _SERIES_AGGS:
                zero = {"sum": 0.0, "count": 0.0, "nunique": 0.0, "prod": 1.0}.get(f.attr)
                return _Grouped(base.key, _aggregate(f.attr, base.expr, None, base.dtype), base.mask, period=base.period, empty=zero)
            if isinstance(base, _Grouped) and not base.median and f.attr in _OUTER:
                return _Nested(base, f.attr)
            if isinstance(base, _Grouped) and not base.median and base.period is None and f.attr in {"idxmax", "idxmin"}:
                return _Nested(base, f.attr)
            if isinstance(base, _Top) and f.attr in _OUTER:
                return _Reduced("top", base.series, f.attr, base.n, base.largest)
            if isinstance(base, _Window) and f.attr in {"mean", "sum", "min", "max"}:
                return _Running(base.series, f"rolling_{f.attr}", base.n)
            if isinstance(base, _Running) and f.attr in _OUTER:
                return _Reduced("running", base.series, f.attr, base.n, fn=base.fn)
            if isinstance(base, _FirstSeries) and f.attr in _OUTER | {"nunique"}:
                first, s = base.frame, base.series
                value = _aggregate(f.attr, F.col(f"`{s.name}`"), None, s.dtype)
                return _Reduced("first", s, None, value=value, key=F.struct(*(F.col(f"`{c}`") for c in first.keys)))
            if isinstance(base, _Frame) and f.attr == "count":
                raise FormulaError("frame-wide count is not a single value")
        raise FormulaError("unsupported call")


def _shape_rows(tree: ast.AST) -> ast.AST:
    """Rewrite ``df.shape[0]`` / ``df[mask].shape[0]`` into ``len(...)``."""

    class R(ast.NodeTransformer):
        def visit_Subscript(self, node):
            self.generic_visit(node)
            if (isinstance(node.value, ast.Attribute) and node.value.attr == "shape"
                    and isinstance(node.slice, ast.Constant) and node.slice.value == 0):
                return ast.Call(func=ast.Name(id="len", ctx=ast.Load()), args=[node.value.value], keywords=[])
            return node

    return ast.fix_missing_locations(R().visit(tree))


def compile_formula(formula: str, schema: T.StructType, median_hook=None) -> CompiledFormula:
    """Compile one KPI formula against a schema. Raises :class:`FormulaError`.

    ``median_hook(expr, mask, q=0.5) -> float`` computes a scalar quantile up front (see
    :func:`quarry.operators.kpi.exact_median_hook`); without it ``median`` is Spark's exact
    ``percentile``, whose final step holds every distinct value in one task.
    """
    if not formula or not formula.strip():
        raise FormulaError("empty formula")
    try:
        tree = ast.parse(formula.strip(), mode="eval")
    except SyntaxError as e:
        raise FormulaError(f"not an expression: {e.msg}") from e
    tree = _shape_rows(tree)
    out = _Compiler(schema, median_hook).visit(tree)
    if isinstance(out, _Grouped):
        # for a median ``value`` is the row expression; the median itself is computed by a
        # distributed selection (quarry.operators.quantiles.grouped_exact_median)
        kind, value = ("grouped_median", out.expr) if out.median else ("grouped", out.expr.try_cast("double"))
        return CompiledFormula(kind, value, key=out.key, mask=out.mask, period=out.period, empty=out.empty)
    if isinstance(out, _Nested):
        g = out.inner
        text = out.outer in {"idxmax", "idxmin"}
        return CompiledFormula("nested", g.expr.try_cast("double"), key=g.key, mask=g.mask, outer=out.outer, text=text, period=g.period, empty=g.empty)
    if isinstance(out, _Reduced):
        value = out.series.expr.cast("double") if out.value is None else out.value.try_cast("double")
        return CompiledFormula(out.kind, value, key=out.key, mask=out.series.mask, outer=out.outer, n=out.n, largest=out.largest, fn=out.fn)
    if isinstance(out, _Repeats):
        raise FormulaError("the formula gives a value per row")
    if isinstance(out, _Agg):
        if out.dtype is not None:
            return CompiledFormula("scalar", out.expr.cast("string"), text=True)
        return CompiledFormula("scalar", out.expr.try_cast("double"))
    if isinstance(out, _Const) and isinstance(out.value, (int, float)) and not isinstance(out.value, bool):
        return CompiledFormula("scalar", F.lit(float(out.value)))
    raise FormulaError("the formula does not reduce to one value or one value per group")

"""Dashboard filters (F1-F9): options and bounds from the unfiltered table, predicates as Columns.

Each filter resolves its column (P13), computes what a widget would offer (date bounds,
option lists, percentile bounds) with one small aggregate on the *unfiltered* table, picks
the default selection the reference starts with, and yields one predicate. Bounds and
options are collected as literals on purpose: literal predicates reach the Parquet scan as
``PushedFilters`` and prune row groups, which a predicate joined against a bounds table
would not. All predicates are ANDed into one ``where`` (Catalyst combines them).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from quarry.functions.names import resolve_column
from quarry.functions.dates import date_column
from quarry.operators.quantiles import exact_quantiles

DATE_DEFAULT_DAYS = 90
MULTISELECT_MAX_OPTIONS = 100
MULTISELECT_DEFAULT_COUNT = 5
SELECTBOX_MAX_OPTIONS = 50
ALL = "All"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class FilterState:
    """What one filter offers and what it applies."""

    name: str
    column: str | None
    type: str
    importance: int = 0
    options: list = field(default_factory=list)
    bounds: tuple | None = None
    selection: object = None
    predicate: Column | None = None
    status: str = "ok"


def time_view(df: DataFrame, column: str) -> Column:
    """Datetime view of a column: text parsed leniently, typed columns as they are."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return date_column(df, column)
    return _q(column)


# -- F1 / F2 / A21: dates -------------------------------------------------------

def date_bounds(df: DataFrame, column: str) -> tuple[_dt.date | None, _dt.date | None]:
    """Min and max as dates (one aggregate)."""
    t = time_view(df, column)
    r = df.agg(F.to_date(F.min(t)).alias("lo"), F.to_date(F.max(t)).alias("hi")).first()
    return r["lo"], r["hi"]


def date_default(lo: _dt.date, hi: _dt.date, days: int = DATE_DEFAULT_DAYS) -> tuple[_dt.date, _dt.date]:
    """the full range, or the last ``days`` days ending at max when the span is longer."""
    if (hi - lo).days > days:
        return hi - _dt.timedelta(days=days), hi
    return lo, hi


def date_predicate(df: DataFrame, column: str, start: _dt.date, end: _dt.date) -> Column:
    """inclusive at date grain; NULLs fail. On a typed column Catalyst rewrites this into
    a timestamp range that is pushed to the scan."""
    return F.to_date(time_view(df, column)).between(F.lit(start), F.lit(end))


# -- F3 / F4: multiselect --------------------------------------------------------

def multiselect_options(df: DataFrame, column: str) -> list:
    """sorted distinct non-NULL values; when there are more than 100, the 100 most
    frequent (count descending, ties by value). One bounded top-k job."""
    top = (
        df.where(_q(column).isNotNull())
        .groupBy(_q(column).alias("v"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc("v"))
        .limit(MULTISELECT_MAX_OPTIONS + 1)
        .collect()
    )
    if len(top) <= MULTISELECT_MAX_OPTIONS:
        return sorted(r["v"] for r in top)
    return [r["v"] for r in top[:MULTISELECT_MAX_OPTIONS]]


def in_predicate(column: str, selected: list) -> Column | None:
    """``column IN selected``; an empty selection means no filter."""
    if not selected:
        return None
    return _q(column).isin(list(selected))


# -- F5 / F6: slider -------------------------------------------------------------

def slider_bounds(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    """1st and 99th percentile, linear interpolation, exact."""
    p1, p99 = exact_quantiles(df, column, [0.01, 0.99])
    return p1, p99


def range_predicate(column: str, lo: float, hi: float) -> Column:
    """inclusive range; NULLs fail."""
    return _q(column).between(F.lit(lo), F.lit(hi))


# -- F7: select one --------------------------------------------------------------

def selectbox_options(df: DataFrame, column: str, k: int = SELECTBOX_MAX_OPTIONS) -> list:
    """``All`` then the k most frequent values."""
    top = (
        df.where(_q(column).isNotNull())
        .groupBy(_q(column).alias("v"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc("v"))
        .limit(k)
        .collect()
    )
    return [ALL] + [r["v"] for r in top]


def equals_predicate(column: str, value) -> Column | None:
    """``All`` means no filter."""
    if value is None or value == ALL:
        return None
    return _q(column) == F.lit(value)


# -- F8 / F9: dispatch and conjunction -------------------------------------------

_UNSET = object()


def build_filter(df: DataFrame, spec: dict, selection=_UNSET) -> FilterState:
    """F8: one filter spec (``name``, ``column``, ``type``, ``importance``) to its state.

    An unknown column is resolved by name similarity or the filter is skipped; ``slider``
    falls back to select-one on a non-numeric column; unknown types are select-one.
    ``selection`` overrides the default the reference starts with.
    """
    name = spec.get("name") or "Filter"
    ftype = spec.get("type") or "multiselect"
    imp = int(spec.get("importance") or 0)
    col = spec.get("column") or ""
    if col not in df.columns:
        col = resolve_column(col, df.columns)
    st = FilterState(name=name, column=col, type=ftype, importance=imp)
    if col is None:
        st.status = "skipped"
        return st
    dtype = df.schema[col].dataType
    if ftype == "date":
        lo, hi = date_bounds(df, col)
        if lo is None:
            st.status = "skipped"
            return st
        st.bounds = (lo, hi)
        start, end = date_default(lo, hi) if selection is _UNSET else selection
        st.selection = (start, end)
        st.predicate = date_predicate(df, col, start, end)
    elif ftype == "multiselect":
        st.options = multiselect_options(df, col)
        sel = st.options[:MULTISELECT_DEFAULT_COUNT] if selection is _UNSET else list(selection or [])
        st.selection = sel
        st.predicate = in_predicate(col, sel)
    elif ftype == "slider" and isinstance(dtype, T.NumericType):
        lo, hi = slider_bounds(df, col)
        if lo is None:
            st.status = "skipped"
            return st
        st.bounds = (lo, hi)
        a, b = (lo, hi) if selection is _UNSET else selection
        st.selection = (a, b)
        st.predicate = range_predicate(col, a, b)
    else:
        st.type = "selectbox"
        st.options = selectbox_options(df, col)
        sel = ALL if selection is _UNSET else selection
        st.selection = sel
        st.predicate = equals_predicate(col, sel)
    return st


def apply_filters(df: DataFrame, specs: list[dict], selections: dict | None = None) -> tuple[DataFrame, list[FilterState]]:
    """all filters in descending importance (stable), ANDed into one ``where``.

    Options and bounds come from ``df`` unfiltered. A filter whose spec does not fit the
    table is skipped, as in the reference; a failed job is an error. ``selections`` maps a filter name to its chosen value;
    ``{}`` keeps the defaults. Reset = use ``df`` itself.
    """
    selections = selections or {}
    ordered = sorted(specs, key=lambda s: -(int(s.get("importance") or 0)))
    states: list[FilterState] = []
    for spec in ordered:
        sel = selections.get(spec.get("name"), _UNSET)
        try:
            st = build_filter(df, spec, sel)
        except (AnalysisException, ValueError, TypeError) as e:  # a spec that does not fit; failed jobs rise
            st = FilterState(name=spec.get("name") or "Filter", column=spec.get("column"),
                             type=spec.get("type") or "", status=f"skipped: {type(e).__name__}")
        states.append(st)
    preds = [s.predicate for s in states if s.predicate is not None]
    if not preds:
        return df, states
    return df.where(reduce(lambda a, b: a & b, preds)), states

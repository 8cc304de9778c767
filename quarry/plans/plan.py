"""Dashboard plans (U2, U3, O7): recommend one from a profile, run one over a table.

A plan is a small spec (domain, KPIs, charts, filters), not data: it is built and
read on the driver. Running it produces lazy DataFrames: one filtered table, one KPI
aggregate, one aggregate per chart, and a tidy union of all chart panels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.missing import without_nan
from quarry.operators import charts as C
from quarry.operators.clean import apply_promotion, promotion_plan
from quarry.operators.derive import chart_product, derive_for_plan, references
from quarry.operators.filters import FilterState, apply_filters
from quarry.operators.kpi import kpis as run_kpis
from quarry.operators.profile import roles
from quarry.functions.names import resolve_column
from quarry.session import ensure_checkpoint_dir

PLAN_SCHEMA = T.StructType([
    T.StructField("domain", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("kpis", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("formula", T.StringType()),
        T.StructField("importance", T.IntegerType()),
        T.StructField("reason", T.StringType()),
    ]))),
    T.StructField("charts", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("importance", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("x_column", T.StringType()),
        T.StructField("y_column", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("grain", T.StringType()),
    ]))),
    T.StructField("filters", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("importance", T.IntegerType()),
    ]))),
])

PANEL_SCHEMA = "panel string, kind string, rank int, x string, x2 string, y double, y2 double"
DEFAULT_DOMAIN = "Data Analytics"


# -- U3: rules ---------------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """An item of a plan that stands whenever the named role slots are filled.

    ``{n0}``, ``{n1}``, ``{d0}``, ``{c0}`` are the first and second numeric, the first date and
    the first categorical column; the same in capitals is its title-cased name.
    """

    section: str
    needs: tuple[str, ...]
    item: dict

    def applied(self, slots: dict[str, str]) -> dict | None:
        if not all(s in slots for s in self.needs):
            return None
        names = slots | {k.upper(): v.title() for k, v in slots.items()}
        return {k: v.format(**names) if isinstance(v, str) else v for k, v in self.item.items()}


# Names, formulas, kinds and importances of recommended items.
RULES = (
    Rule("kpis", ("n0",), {"name": "Total {N0}", "formula": "df['{n0}'].sum()", "importance": 10,
                           "description": "{n0}, added up", "reason": "The scale of the table in terms of {n0}."}),
    Rule("kpis", ("n1",), {"name": "Average {N1}", "formula": "df['{n1}'].mean()", "importance": 8,
                           "description": "{n1}, averaged over rows", "reason": "What one row contributes in {n1}."}),
    Rule("charts", ("d0", "n0"), {"name": "{N0} Trend", "type": "time_series", "importance": 10,
                                  "x_column": "{d0}", "y_column": "{n0}", "description": "{n0} along {d0}"}),
    Rule("charts", ("c0", "n0"), {"name": "{N0} by {C0}", "type": "bar", "importance": 9,
                                  "x_column": "{c0}", "y_column": "{n0}", "description": "The values of {c0} with most {n0}"}),
    Rule("charts", ("n0",), {"name": "{N0} Distribution", "type": "histogram", "importance": 7,
                             "x_column": "{n0}", "y_column": None, "description": "Where the values of {n0} lie"}),
    Rule("charts", ("n0", "n1"), {"name": "{N0} vs {N1}", "type": "scatter", "importance": 6,
                                  "x_column": "{n0}", "y_column": "{n1}", "description": "{n0} against {n1}"}),
    Rule("filters", ("d0",), {"name": "{D0} Filter", "column": "{d0}", "type": "date", "importance": 10}),
    Rule("filters", ("c0",), {"name": "{C0} Filter", "column": "{c0}", "type": "multiselect", "importance": 8}),
)


def recommend_plan(profile_columns: list[dict], domain: str = DEFAULT_DOMAIN) -> dict:
    """The plan of ``RULES`` for a profile's columns, in position order."""
    r = roles(sorted(profile_columns, key=lambda c: c.get("position", 0)))
    named = {"d": r["dates"], "n": r["numerics"], "c": r["categoricals"]}
    slots = {f"{k}{i}": name for k, names in named.items() for i, name in enumerate(names[:2])}
    plan: dict = {"domain": {"name": domain}, "kpis": [], "charts": [], "filters": []}
    for rule in RULES:
        item = rule.applied(slots)
        if item:
            plan[rule.section].append(item)
    return plan


def ordered(items: list[dict]) -> list[dict]:
    """By importance, descending, stable."""
    return sorted(items or [], key=lambda i: -(int(i.get("importance") or 0)))


def plan_frame(spark: SparkSession, plan: dict) -> DataFrame:
    """The plan as rows ``(section, rank, name, type, x_column, y_column, formula, importance)``."""
    rows = []
    for sec in ("kpis", "charts", "filters"):
        for rank, it in enumerate(ordered(plan.get(sec, [])), start=1):
            rows.append((
                sec, rank, it.get("name"),
                it.get("type") if sec != "kpis" else "kpi",
                it.get("x_column") if sec == "charts" else it.get("column"),
                it.get("y_column") if sec == "charts" else None,
                it.get("formula") if sec == "kpis" else None,
                int(it.get("importance") or 0),
            ))
    return spark.createDataFrame(
        rows, "section string, rank int, name string, type string, x_column string, y_column string, "
              "formula string, importance int")


# -- U2: run -----------------------------------------------------------------------

@dataclass
class Dashboard:
    """Everything a dashboard shows, as lazy DataFrames (filters already decided)."""

    filtered: DataFrame
    filters: list[FilterState]
    kpis: DataFrame
    grouped_kpis: DataFrame
    charts: dict = field(default_factory=dict)
    chart_status: dict = field(default_factory=dict)

    def is_empty(self) -> bool:
        """The reference stops the dashboard when the filters leave no row."""
        return self.filtered.isEmpty()

    def panels(self) -> DataFrame:
        """All chart tables in one tidy frame ``(panel, kind, rank, x, x2, y, y2)``."""
        parts = [p for p in self.charts.values() if p is not None]
        if not parts:
            return self.filtered.sparkSession.createDataFrame([], PANEL_SCHEMA)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def _tidy(name: str, kind: str, rank: int, df: DataFrame, x, x2, y, y2) -> DataFrame:
    none_s = F.lit(None).cast("string")
    none_d = F.lit(None).cast("double")
    return df.select(
        F.lit(name).alias("panel"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"),
        (_s(x) if x is not None else none_s).alias("x"),
        (_s(x2) if x2 is not None else none_s).alias("x2"),
        (_d(y) if y is not None else none_d).alias("y"),
        (_d(y2) if y2 is not None else none_d).alias("y2"),
    )


# The tables feed the tidy panel union, where row order is not kept, so charts whose order
# is only presentation skip their global sort; top-k charts keep the bounded
# ``orderBy().limit()`` that picks their rows.
CHARTS = {
    "time_series": lambda df, c: C.time_series(df, c["x"], c["y"], grain=c["grain"], ordered=False),
    "bar": lambda df, c: C.bar(df, c["x"], c["y"]),
    "histogram": lambda df, c: C.histogram(df, c["x"], ordered=False),
    "scatter": lambda df, c: C.scatter(df, c["x"], c["y"]),
    "heatmap": lambda df, c: C.correlation(df),
    "pie": lambda df, c: C.pie(df, c["x"], c["y"]),
    "funnel": lambda df, c: C.funnel(df, c["x"], c["y"], ordered=False),
}
#: Charts that need their y column.
_NEED_Y = {"time_series", "scatter", "funnel"}


def chart_columns(df: DataFrame, chart: dict) -> tuple[DataFrame, dict]:
    """The columns a chart spec means, and the frame with any product it names (P12). A name
    that means no column is a ``ValueError``."""
    def found(name: str | None) -> str | None:
        if not name or name in df.columns:
            return name or None
        actual = resolve_column(name, df.columns)
        if actual is None:
            raise ValueError(f"no column for {name!r}")
        return actual

    y = chart.get("y_column")
    if y and "(" in y:
        df, y = chart_product(df, y)
        if y is None:
            raise ValueError(f"no product in {chart['y_column']!r}")
    return df, {"x": found(chart.get("x_column")), "y": found(y), "grain": chart.get("grain")}


def chart_table(df: DataFrame, chart: dict) -> tuple[DataFrame, str]:
    """One chart spec to its table and the kind it was drawn as; an unknown kind is a preview."""
    kind = chart.get("type") or "bar"
    df, cols = chart_columns(df, chart)
    if kind not in CHARTS:
        return C.preview(df), "preview"
    if kind != "heatmap" and not cols["x"] or kind in _NEED_Y and not cols["y"]:
        raise ValueError(f"a {kind} chart needs more columns")
    return CHARTS[kind](df, cols), kind


def _panel(name: str, kind: str, rank: int, t: DataFrame) -> DataFrame:
    cols = t.columns
    if kind == "histogram":
        if "bin_lo" in cols:
            return _tidy(name, kind, rank, t, "bin_lo", "bin_hi", "count", None)
        return _tidy(name, kind, rank, t, "x", None, "count", None)
    if kind == "heatmap":
        return _tidy(name, kind, rank, t, "col_x", "col_y", "corr", None)
    if kind == "pie":
        return _tidy(name, kind, rank, t, "x", None, "y", "share")
    if kind == "preview":
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]))
        return _tidy(name, kind, rank, t, row, None, None, None)
    return _tidy(name, kind, rank, t, "x", None, "y", None)


def run_plan(df: DataFrame, plan: dict, selections: dict | None = None, materialize: str = "none", order_by: list[str] | None = None) -> Dashboard:
    """Derived columns -> filters (defaults unless ``selections``) -> KPIs -> charts.

    Filter options and bounds are computed on ``df`` before filtering, as the reference
    does. By default (``materialize='none'``) each panel re-reads only its own columns
    with the filter predicates pushed into the Parquet scan, which on large inputs is
    cheaper than keeping every column of the filtered table. ``'cache'`` keeps the
    filtered table in executor memory/disk (recomputed from lineage if an executor is
    lost); ``'checkpoint'`` writes it once to the shared checkpoint location
    (``spark.checkpoint.dir``), cutting the lineage so panels survive executor loss
    without re-running the filters. ``order_by`` is the order of rows that KPIs such as
    ``df['v'].cumsum().max()`` mean; without it they are ``unsupported``.
    """
    base = derive_for_plan(typed_for_plan(without_nan(df), plan), plan)
    filtered, states = apply_filters(base, plan.get("filters", []), selections)
    if materialize == "cache":
        filtered = filtered.persist()
    elif materialize == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        filtered = filtered.checkpoint(eager=True)
    scal, grouped = run_kpis(filtered, plan.get("kpis", []), order_by)
    charts: dict = {}
    status: dict = {}
    for rank, ch in enumerate(ordered(plan.get("charts", [])), start=1):
        name = ch.get("name") or f"chart{rank}"
        key = name if name not in charts else f"{name} #{rank}"
        try:
            t, kind = chart_table(filtered, ch)
            charts[key], status[key] = _panel(key, kind, rank, t), "preview" if kind == "preview" else "ok"
        except (AnalysisException, ValueError) as e:  # the spec does not fit the table; failed jobs rise
            status[key] = f"error: {e}".split("\n")[0]
            one = df.sparkSession.range(1)
            charts[key] = _tidy(key, "error", rank, one, F.lit(status[key]), None, None, None)
    return Dashboard(filtered=filtered, filters=states, kpis=scal, grouped_kpis=grouped,
                     charts=charts, chart_status=status)


def typed_for_plan(df: DataFrame, plan: dict) -> DataFrame:
    """Text columns that the plan adds up or measures, as numbers where every value reads as one
    (one aggregate over just those columns)."""
    charts = plan.get("charts", []) or []
    named = [c.get("y_column") for c in charts]
    named += [c.get("x_column") for c in charts if c.get("type") in ("histogram", "scatter")]
    texts = [k.get("formula") for k in plan.get("kpis", []) or []] + named
    named += [r for t in texts for r in references(t)]
    named += [f.get("column") for f in plan.get("filters", []) or [] if f.get("type") == "slider"]
    meant = {n if n in df.columns else resolve_column(n, df.columns) for n in named if n}
    text = [f.name for f in df.schema.fields if f.name in meant and isinstance(f.dataType, T.StringType)]
    decided = promotion_plan(df.select(*(F.col(f"`{c}`") for c in text))) if text else {}
    numbers = {c: t for c, t in decided.items() if t in ("long", "double") or t.startswith("decimal")}
    return apply_promotion(df, numbers) if numbers else df

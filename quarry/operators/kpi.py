"""KPIs (A11, A12, U1): the scalar KPIs of a plan in one aggregate, grouped KPIs as rows, and
small plans for formulas over grouped, ordered or distinct rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.format import format_kpi_value
from quarry.functions.formula import PERIODS, CompiledFormula, FormulaError, compile_formula, reduce_values
from quarry.operators.ordered import running
from quarry.operators.quantiles import exact_quantiles, grouped_exact_median

KPI_SCHEMA = "rank int, name string, formula string, value double, formatted string, status string"
GROUPED_SCHEMA = "name string, key string, value double"


def exact_median_hook(df: DataFrame):
    """Scalar medians by distributed selection (:func:`exact_quantiles`), not by one task."""

    def hook(expr, mask, q=0.5):
        src = df if mask is None else df.where(mask)
        return exact_quantiles(src.select(expr.alias("__m")), "__m", [q])[0]

    return hook


#: Kinds of formula that are one value out of a plan of their own.
OWN_PLAN = ("nested", "top", "first", "running")


def _source(df: DataFrame, c: CompiledFormula) -> DataFrame:
    return df if c.mask is None else df.where(c.mask)


def _spine(groups: DataFrame, c: CompiledFormula) -> DataFrame:
    """Groups by period with a row for every period between the first and the last, labelled."""
    unit, step, end = PERIODS[c.period]
    ends = groups.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where(F.col("lo").isNotNull())
    every = ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias("key"))
    value = F.col("value") if c.empty is None else F.coalesce("value", F.lit(c.empty))
    last = F.expr(f"key + interval {step} - interval 1 day") if end else F.col("key")
    label = F.date_format(last, "yyyy-MM-dd HH:mm:ss" if unit == "hour" else "yyyy-MM-dd")
    return every.join(groups, "key", "left").select(label.alias("key"), value.alias("value"))


def _groups(df: DataFrame, c: CompiledFormula) -> DataFrame:
    """``(key, value)`` of a grouped formula; missing keys dropped."""
    rows = _source(df, c).withColumn("__key", c.key).where(F.col("__key").isNotNull())
    groups = rows.groupBy(F.col("__key").alias("key")).agg(c.value.alias("value"))
    return groups if c.period is None else _spine(groups, c)


def own_plan(df: DataFrame, c: CompiledFormula, order_by: list[str] | None = None) -> DataFrame:
    """One row, ``value`` and ``text`` (set when the result is no number): a formula that is no
    aggregate of the rows themselves.

    * nested: the aggregates of all keys, reduced again, or the key of the largest or smallest
      (ties by the lesser key);
    * top: the n largest or smallest values, found by bounded heaps, reduced;
    * first: per key the first row by ``order_by`` (by all columns without it), then an aggregate;
    * running: a function of the rows in the order of ``order_by``, reduced.
    """
    none = F.lit(None).cast("string").alias("text")
    if c.kind == "top":
        v = F.col("v")
        rows = _source(df, c).select(c.value.alias("v")).where(v.isNotNull() & ~F.isnan(v))
        rows = rows.orderBy(v.desc() if c.largest else v.asc()).limit(c.n)
        return rows.agg(reduce_values(c.outer, v).cast("double").alias("value")).select("value", none)
    if c.kind == "first":
        names = order_by or df.columns
        rows = _source(df, c).groupBy(c.key.alias("__key")).agg(F.min(F.struct(*(F.col(f"`{n}`") for n in dict.fromkeys([*names, *df.columns])))).alias("row"))
        return rows.select("row.*").agg(c.value.alias("value")).select("value", none)
    if c.kind == "running":
        if not order_by:
            raise FormulaError("the formula needs an order of rows")
        rows = running(df, order_by, c.value, c.fn, c.n, c.mask)
        return rows.agg(reduce_values(c.outer, F.col("r")).cast("double").alias("value")).select("value", none)
    groups = _groups(df, c)
    if c.outer in ("idxmax", "idxmin"):
        size = -F.col("value") if c.outer == "idxmax" else F.col("value")
        best = F.min(F.when(F.col("value").isNotNull(), F.struct(size.alias("size"), "key")))["key"]
        if isinstance(groups.schema["key"].dataType, T.NumericType):
            return groups.agg(best.cast("double").alias("value")).select("value", none)
        return groups.agg(best.cast("string").alias("text")).select(F.lit(None).cast("double").alias("value"), "text")
    return groups.agg(reduce_values(c.outer, F.col("value")).cast("double").alias("value")).select("value", none)


def kpi_value(df: DataFrame, formula: str, order_by: list[str] | None = None) -> float | str | None:
    """One scalar KPI evaluated now (a single aggregate in the usual case)."""
    c = compile_formula(formula, df.schema, exact_median_hook(df))
    if c.kind in OWN_PLAN:
        r = own_plan(df, c, order_by).first()
        return r["value"] if r["text"] is None else r["text"]
    if c.kind != "scalar":
        raise FormulaError("grouped formula; use grouped_kpi")
    return df.agg(c.value.alias("v")).first()["v"]


def grouped_kpi(df: DataFrame, formula: str, name: str = "kpi") -> DataFrame:
    """``df.groupby(k)[v].agg()`` as rows ``(name, key, value)``; NULL keys dropped."""
    c = compile_formula(formula, df.schema)
    if c.kind not in ("grouped", "grouped_median"):
        raise FormulaError("not a grouped formula")
    if c.kind == "grouped_median":
        med = grouped_exact_median(_source(df, c).select(c.key.cast("string").alias("key"), c.value.alias("__v")), "key", "__v")
        return med.select(F.lit(name).alias("name"), "key", F.col("median").alias("value"))
    return _groups(df, c).select(F.lit(name).alias("name"), F.col("key").cast("string").alias("key"), "value")


def kpis(df: DataFrame, kpi_specs: list[dict], order_by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All KPIs of a plan, in descending importance (stable).

    Returns ``(scalars, grouped)``. Scalars are one ``df.agg`` over every scalar formula that is
    an aggregate of the rows, and a small plan for each that is not (``own_plan``), as ``(rank,
    name, formula, value, formatted, status)``; a value that is no number (a key, a time) is
    the formatted text. Formulas outside the grammar get status ``unsupported`` and a NULL
    value, and so do those over ordered rows without ``order_by``. Grouped formulas are
    unioned into ``(name, key, value)``.
    """
    spark = df.sparkSession
    ordered = sorted(kpi_specs or [], key=lambda k: -(int(k.get("importance") or 0)))
    scalar_exprs, meta, grouped_parts, own_parts = [], [], [], []
    for rank, spec in enumerate(ordered, start=1):
        name = spec.get("name") or "KPI"
        formula = spec.get("formula") or ""
        try:
            c: CompiledFormula = compile_formula(formula, df.schema, exact_median_hook(df))
            if c.kind in OWN_PLAN:
                said = (F.lit(rank).alias("rank"), F.lit(name).alias("name"), F.lit(formula).alias("formula"))
                own_parts.append(own_plan(df, c, order_by).select(*said, "value", "text", F.lit("ok").alias("status")))
            elif c.kind in ("grouped", "grouped_median"):
                grouped_parts.append(grouped_kpi(df, formula, name))
                meta.append((rank, name, formula, None, "grouped", False))
            else:
                alias = f"k{len(scalar_exprs)}"
                scalar_exprs.append(c.value.alias(alias))
                meta.append((rank, name, formula, alias, "ok", c.text))
        except FormulaError:
            meta.append((rank, name, formula, None, "unsupported", False))
    if scalar_exprs:
        row = df.agg(*scalar_exprs)
        cells = []
        for rank, name, formula, alias, status, text in meta:
            v = (F.col(alias) if alias and not text else F.lit(None)).cast("double")
            t = (F.col(alias) if alias and text else F.lit(None)).cast("string")
            cells.append(F.struct(
                F.lit(rank).alias("rank"), F.lit(name).alias("name"), F.lit(formula).alias("formula"),
                v.alias("value"), t.alias("text"), F.lit(status).alias("status")))
        scal = row.select(F.inline(F.array(*cells)))
    else:
        scal = spark.createDataFrame(
            [(r, n, f, None, None, s) for r, n, f, _, s, _ in meta],
            "rank int, name string, formula string, value double, text string, status string")
    for part in own_parts:
        scal = scal.unionByName(part)
    scal = scal.select("rank", "name", "formula", "value", F.coalesce("text", format_kpi_value(F.col("value"))).alias("formatted"), "status")
    if grouped_parts:
        grouped = grouped_parts[0]
        for g in grouped_parts[1:]:
            grouped = grouped.unionByName(g)
    else:
        grouped = spark.createDataFrame([], GROUPED_SCHEMA)
    return scal, grouped

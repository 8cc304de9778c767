"""The physical plans the scale design relies on: pushdown, bounded top-k, codegen."""

import contextlib
import io
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.operators import clean as CL
from quarry.operators import profile as P
from quarry.operators.profile import FIELD_BUDGET, evidence_exprs


def _plan(df, mode="simple", execute: bool = False) -> str:
    """The physical plan text; with ``execute`` the adaptive plan is the final one."""
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        if execute:
            df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode)
        return buf.getvalue()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)


def test_filter_bounds_reach_the_scan(spark, sf_dir):
    plan = _plan(E.queries()["filters_conjunction"](spark, sf_dir))
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed
    assert "In(o_orderpriority" in pushed
    assert "GreaterThanOrEqual(o_totalprice" in pushed and "LessThanOrEqual(o_totalprice" in pushed


def test_topk_is_bounded_and_partial(spark, sf_dir):
    plan = _plan(E.queries()["bar_sum_top10"](spark, sf_dir))
    assert "TakeOrderedAndProject(limit=10" in plan
    assert "partial_sum" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in plan


def test_evidence_aggregate_is_codegen(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    items = [(1, F.count(F.lit(1)).alias("rows"))]
    for i, f in enumerate(li.schema.fields):
        items += evidence_exprs(i, f.name, f.dataType)
    assert sum(n for n, _ in items) <= FIELD_BUDGET
    plan = _plan(li.agg(*[e for _, e in items]), execute=True)
    assert "isFinalPlan=true" in plan
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    # whole-stage codegen marks both aggregation steps with "*(n)"
    final = plan.split("Initial Plan")[0]
    agg_lines = [ln for ln in final.splitlines() if "HashAggregate(" in ln]
    assert len(agg_lines) >= 2 and all("*(" in ln for ln in agg_lines), agg_lines


def test_frequency_table_partial_aggregation(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = _plan(P.frequency_table(ev).groupBy("pos").count())
    # values are grouped map-side before the shuffle, and numbers are never cast to text
    assert plan.count("HashAggregate(keys=[pos") >= 2
    assert "cast(event_id" not in plan.replace("cast(event_id#", "")  # no string cast of ids


def test_panels_carry_no_global_sort(spark, sf_dir):
    plan = _plan(E.queries()["auto_dashboard"](spark, sf_dir))
    assert "rangepartitioning" not in plan and "Sort [" not in plan


def test_ingest_code_is_compiled_by_the_jvm(spark, sf_dir):
    """Methods of generated code of more than 8000 bytes are interpreted, row by row."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    df = li.select(*(F.col(c).cast("string").alias(f"{c}_{i}") for i in range(2) for c in li.columns if c != "l_shipdate"))
    plan = CL.promotion_plan(df)
    assert {t for c, t in plan.items() if not c.startswith("l_l") and not c.startswith("l_r")} == {"long", "double"}
    for out in (CL.kind_counts(df, df.columns), CL.apply_promotion(df, plan)):
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:\s*(\d+)", _plan(out, "codegen", execute=True))]
        assert sizes and max(sizes) < 8000, sizes

"""Charts, filters, KPIs and derived columns on literal inputs (ledger L12-L20, F2, F4)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.format import format_kpi_value
from quarry.functions.formula import FormulaError, compile_formula
from quarry.operators import charts as C
from quarry.operators import filters as FL
from quarry.operators import quantiles as Q
from quarry.operators.clean import display_prep, drop_empty_columns
from quarry.operators.derive import chart_product, convention_columns, product_columns
from quarry.operators.kpi import grouped_kpi, kpi_value, kpis


def test_l12_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 5.0), (3.0, None, 5.0), (None, 9.0, 5.0)],
                               "a double, b double, c double")
    got = {(r["col_x"], r["col_y"]): r["corr"] for r in C.correlation(df).collect()}
    assert math.isclose(got[("a", "b")], 1.0)
    assert got[("a", "c")] is None and got[("c", "a")] is None
    assert got[("a", "a")] == 1.0 and got[("c", "c")] is None
    assert len(got) == 9


def test_correlation_symmetric_and_matches_numpy(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m = {(r["col_x"], r["col_y"]): r["corr"] for r in C.correlation(li).collect()}
    for (a, b), v in m.items():
        assert m[(b, a)] == v
    pdf = li.select("l_quantity", "l_extendedprice").toPandas()
    ref = np.corrcoef(pdf["l_quantity"], pdf["l_extendedprice"])[0, 1]
    assert math.isclose(m[("l_quantity", "l_extendedprice")], ref, rel_tol=1e-9)


def test_heatmap_needs_two_columns(spark):
    assert C.correlation(spark.createDataFrame([(1.0,)], "a double")).count() == 0


def test_l13_empty_sums(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 5.0)], "k string, v double")
    got = {r["x"]: r["y"] for r in C.funnel(df, "k", "v").collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_l16_histogram(spark):
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [tuple(r) for r in C.histogram(const, "x").collect()] == [(0, 3.0, 3.0, 2)]
    df = spark.range(0, 101).select(F.col("id").cast("double").alias("x"))
    h = C.histogram(df, "x").collect()
    assert sum(r["count"] for r in h) == 101
    assert h[-1]["bin"] == 19 and h[-1]["bin_hi"] == 100.0
    assert len(C.histogram(df, "x", keep_empty=True).collect()) == 20
    txt = spark.createDataFrame([("a",), ("b",), ("a",)], "x string")
    assert [tuple(r) for r in C.histogram(txt, "x").collect()] == [("a", 2), ("b", 1)]


def test_l18_pie_first8_by_key(spark):
    df = spark.createDataFrame([(f"k{i:02d}", float(i)) for i in range(10)], "k string, v double")
    rows = C.pie(df, "k", "v").collect()
    assert [r["x"] for r in rows] == [f"k{i:02d}" for i in range(8)]
    assert math.isclose(sum(r["share"] for r in rows), 1.0)
    big = C.pie(df, "k", "v", by="largest").collect()
    assert {r["x"] for r in big} == {f"k{i:02d}" for i in range(2, 10)}


def test_l20_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), ("b",)], "k string")
    assert [r["x"] for r in C.bar(df, "k").collect()] == ["a", "b", "c"]
    assert [r["x"] for r in C.pie(df, "k").collect()] == ["a", "b", "c"]


def test_bar_sum_top(spark):
    df = spark.createDataFrame([(str(i), float(i % 4)) for i in range(20)], "k string, v double")
    rows = C.bar(df, "k", "v", k=3).collect()
    assert [r["x"] for r in rows] == ["11", "15", "19"]


def test_time_series_text_dates(spark):
    df = spark.createDataFrame([("2024-01-02", 1.0), ("01/02/2024", 2.0), ("junk", 5.0)], "d string, v double")
    rows = C.time_series(df, "d", "v").collect()
    assert [(r["x"], r["y"]) for r in rows] == [(dt.datetime(2024, 1, 2), 3.0)]


def test_f2_date_default():
    lo, hi = dt.date(2024, 1, 1), dt.date(2024, 1, 31)
    assert FL.date_default(lo, hi) == (lo, hi)
    lo2 = dt.date(2023, 1, 1)
    assert FL.date_default(lo2, hi) == (dt.date(2023, 11, 2), hi)


def test_f4_options(spark):
    small = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "v string")
    assert FL.multiselect_options(small, "v") == ["a", "b", "c"]
    rows = [(f"v{i:03d}",) for i in range(101)] + [("v100",)] * 3 + [("v050",)] * 2
    big = spark.createDataFrame(rows, "v string")
    opts = FL.multiselect_options(big, "v")
    assert len(opts) == 100 and opts[:3] == ["v100", "v050", "v000"]
    f, st = FL.apply_filters(big, [{"name": "V", "column": "v", "type": "multiselect"}])
    assert st[0].selection == ["v100", "v050", "v000", "v001", "v002"]
    assert f.count() == 4 + 3 + 3


def test_filter_dispatch_and_skip(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    f, st = FL.apply_filters(df, [
        {"name": "missing", "column": "zzz", "type": "multiselect", "importance": 9},
        {"name": "slider on text", "column": "k", "type": "slider", "importance": 5},
    ])
    assert st[0].status == "skipped"
    assert st[1].type == "selectbox" and st[1].options == ["All", "a", "b"]
    assert f.count() == 2
    f2, _ = FL.apply_filters(df, [{"name": "K", "column": "k", "type": "selectbox"}], {"K": "b"})
    assert [r["k"] for r in f2.collect()] == ["b"]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_exact_quantiles_small(spark, n):
    vals = [float((i * 7919) % 1009) / 7 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = Q.exact_quantiles(df, "x", [0.01, 0.5, 0.99])
    ref = np.quantile(vals, [0.01, 0.5, 0.99])
    assert np.allclose(got, ref, rtol=0, atol=1e-9)


def test_exact_quantiles_refinement_path(spark, monkeypatch):
    monkeypatch.setattr(Q, "GATHER", 50)
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.lognormal(0, 3, 3000), np.full(1500, 42.0)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = Q.exact_quantiles(df, "x", [0.01, 0.3, 0.5, 0.99])
    ref = np.quantile(vals, [0.01, 0.3, 0.5, 0.99])
    assert np.allclose(got, ref, rtol=1e-12, atol=0)


def test_kpi_formula_forms(spark):
    df = spark.createDataFrame([("a", 2.0, 3.0), ("b", None, 1.0), ("a", 4.0, 2.0), (None, 1.0, 1.0)],
                               "k string, x double, y double")
    assert kpi_value(df, "df['x'].sum()") == 7.0
    assert kpi_value(df, "len(df)") == 4.0
    assert kpi_value(df, "df['x'].count()") == 3.0
    assert kpi_value(df, "(df['x'] * df['y']).sum()") == 15.0
    assert kpi_value(df, "(df['k'] == 'a').mean()") == 0.5
    assert kpi_value(df, "(df['k'] != 'a').sum()") == 2.0
    assert kpi_value(df, "len(df[df['x'] > 1.5])") == 2.0
    assert kpi_value(df, "df[df['k'] == 'a']['y'].sum()") == 5.0
    assert kpi_value(df, "df['x'].sum() / len(df)") == 1.75
    assert kpi_value(df, "df['x'].sum() / 0") is None
    assert kpi_value(df, "df['X'].max()") == 4.0
    assert kpi_value(df, "np.mean(df['y'])") == 1.75
    assert kpi_value(df, "df.shape[0]") == 4.0
    assert kpi_value(df, "df['k'].nunique()") == 2.0
    assert math.isclose(kpi_value(df, "df['y'].std()"), float(np.std([3.0, 1.0, 2.0, 1.0], ddof=1)))
    assert kpi_value(df.where("false"), "df['x'].sum()") == 0.0
    assert kpi_value(df.where("false"), "df['x'].mean()") is None


def test_l14_grouped_and_unsupported(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 2.0), (None, 5.0)], "k string, v double")
    got = {r["key"]: r["value"] for r in grouped_kpi(df, "df.groupby('k')['v'].sum()").collect()}
    assert got == {"a": 3.0, "b": 0.0}
    for bad in ["open('x')", "__import__('os')", "df['v'].apply(len)", "df", "1 +", "df['nope'].sum()"]:
        with pytest.raises(FormulaError):
            compile_formula(bad, df.schema)
    scal, grouped = kpis(df, [{"name": "bad", "formula": "open('x')"}, {"name": "g", "formula":
                                                                         "df.groupby('k')['v'].sum()"}])
    st = {r["name"]: r["status"] for r in scal.collect()}
    assert st == {"bad": "unsupported", "g": "grouped"}
    assert grouped.count() == 2


@pytest.mark.parametrize("v, want", [
    (0.0, "0"), (0.4, "0"), (-0.4, "-0"), (2.5, "2"), (999.4, "999"), (-999.86, "-1,000"), (1234.5, "1.2K"),
    (1_250_000.0, "1.2M"), (2.5e9, "2.5B"), (-3.3e6, "-3.3M"), (12345.65e9, "12345.6B"),
])
def test_kpi_format(spark, v, want):
    assert spark.range(1).select(format_kpi_value(F.lit(v)).alias("f")).first()["f"] == want


def test_p10_p12_derived(spark):
    df = spark.createDataFrame([(2.0, 3.0, 4.0, 5.0)], "quantity double, unitprice double, price double, qty double")
    out = convention_columns(df).first()
    assert (out["total_sales"], out["total_amount"], out["revenue"]) == (6.0, 20.0, 6.0)
    out2 = product_columns(df, ["(df['quantity'] * df['unitprice']).sum()"])
    assert out2.first()["quantity_unitprice_product"] == 6.0
    out3, name = chart_product(df, "(df['qty'] * df['unit_price'])")
    assert name == "qty_x_price" and out3.first()[name] == 20.0
    assert chart_product(df, "(df['qty'] * df['cost'])")[1] is None


def test_display_prep(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-02", None, "nan", None), ("2", "bad", None, "x", None), ("z", None, None, "None", None)],
        "code string, order_date string, empty_num double, txt string, empty_txt string")
    rows = display_prep(df).collect()
    assert display_prep(df).columns == ["code", "order_date", "txt", "empty_txt"]
    assert [r["code"] for r in rows] == [1.0, 2.0, 0.0]
    assert [r["order_date"] for r in rows] == ["2024-01-02 00:00:00", "", ""]
    assert [r["txt"] for r in rows] == ["", "x", ""]
    assert [r["empty_txt"] for r in rows] == ["", "", ""]


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert drop_empty_columns(df).columns == ["a"]


def test_scalar_median_exact(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 3, 2, 8, 13]] + [(None,)], "x double")
    assert kpi_value(df, "df['x'].median()") == 4.0
    assert kpi_value(df, "df[df['x'] > 2]['x'].median() + 1") == 7.5
    assert kpi_value(df.where("false"), "df['x'].median()") is None


def test_time_grains_wall_clock(spark):
    rows = [(dt.datetime(2024, 3, 10, 1, 30), 1.0), (dt.datetime(2024, 3, 10, 23, 59), 2.0),
            (dt.datetime(2024, 2, 29, 12, 0), 4.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        day = [(r["x"], r["y"]) for r in C.time_series(df, "t", "v", grain="day").collect()]
        month = [(r["x"], r["y"]) for r in C.time_series(df, "t", "v", grain="month").collect()]
        hour = [r["x"] for r in C.time_series(df, "t", "v", grain="hour").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert day == [(dt.datetime(2024, 2, 29), 4.0), (dt.datetime(2024, 3, 10), 3.0)]
    assert month == [(dt.datetime(2024, 2, 1), 4.0), (dt.datetime(2024, 3, 1), 3.0)]
    assert hour[0] == dt.datetime(2024, 2, 29, 12, 0)


def test_grouped_median_exact_with_hot_group(spark):
    import pandas as pd
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(3000) < 0.4, "hot", rng.choice(["a", "b", "c", "d"], 3000))
    vals = np.round(rng.normal(50, 20, 3000), 1)
    vals[::17] = np.nan
    pdf = pd.DataFrame({"k": keys, "v": vals})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = {r["k"]: r["median"] for r in Q.grouped_exact_median(df, "k", "v", partitions=7).collect()}
    want = pdf.groupby("k")["v"].median().to_dict()
    assert got.keys() == want.keys()
    for k in want:
        assert math.isclose(got[k], want[k], abs_tol=1e-12), k
    via_kpi = {r["key"]: r["value"] for r in grouped_kpi(df, "df.groupby('k')['v'].median()").collect()}
    assert via_kpi == got


def test_correlation_wide_table(spark):
    # 40 numeric columns: the statistics and pair aggregates are split under the field budget
    base = spark.range(200).select((F.col("id") * 1.0).alias("x"))
    cols = [(F.col("x") * (i + 1) + F.lit(i) * F.sin(F.col("x") * (i + 1))).alias(f"c{i}") for i in range(40)]
    wide = base.select(*cols)
    got = {(r["col_x"], r["col_y"]): r["corr"] for r in C.correlation(wide).collect()}
    assert len(got) == 40 * 40
    pdf = wide.toPandas()
    ref = pdf.corr()
    for a, b in [("c0", "c1"), ("c5", "c39"), ("c12", "c30")]:
        assert math.isclose(got[(a, b)], ref.loc[a, b], rel_tol=1e-9, abs_tol=1e-12)


def test_totals_and_products_do_not_overflow(spark):
    big = spark.createDataFrame([("a", 4 * 10**18)] * 4, "k string, v long")
    assert C.bar(big, "k", "v").first()["y"] == 16 * 10**18
    assert C.pie(big, "k", "v").first()["y"] == C.funnel(big, "k", "v").first()["y"] == 16 * 10**18
    assert kpi_value(big, "df['v'].sum()") == 16e18
    ints = spark.createDataFrame([(100000, 100000)], "quantity int, unitprice int")
    assert convention_columns(ints).first()["total_sales"] == 10**10


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", float("nan")), ("b", None)], "k string, v double")
    assert Q.exact_quantiles(df, "v", [0.5]) == [1.5]
    assert sum(r["count"] for r in C.histogram(df, "v").collect()) == 2
    assert {r["x"]: r["y"] for r in C.bar(df, "k", "v").collect()} == {"a": 3.0, "b": 0.0}


def test_quantile_scans_do_not_grow_with_the_ranks(spark, monkeypatch):
    df = spark.range(100_000).selectExpr("cast(id * id as double) as v")
    scans = []
    refined = Q._refined
    monkeypatch.setattr(Q, "_refined", lambda vals, ranges: scans.append(len(ranges)) or refined(vals, ranges))
    got = Q.exact_quantiles(df, "v", [0.01, 0.25, 0.5, 0.75, 0.99])
    assert np.allclose(got, np.quantile(np.arange(100_000.0) ** 2, [0.01, 0.25, 0.5, 0.75, 0.99])) and len(scans) <= 2


def test_formula_methods_and_nested_reductions(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, None)], "k string, v double")
    for f, want in {
        "df.groupby('k')['v'].sum().mean()": 4.5, "df['k'].value_counts().max()": 2.0, "df['k'].isin(['a', 'c']).sum()": 2.0,
        "df['v'].isna().sum()": 1.0, "df[df['v'].between(2, 9)]['v'].sum()": 8.0, "df['v'].quantile(0.5)": 3.0,
        "len(df['k'].unique())": 3.0, "round(df['v'].mean(), 0)": 3.0, "df['v'].fillna(0).mean()": 2.25, "2 ** 70": float(2**70),
    }.items():
        assert kpi_value(df, f) == want, f
    for bad in ("df['v'].isin(df['v'])", "9.0 ** 99999", "df['v'].between(1)", "df.groupby('k')['v'].sum().median()"):
        with pytest.raises(FormulaError):
            compile_formula(bad, df.schema)

"""Registered queries: one per operator group of the blueprint, each with a DuckDB twin.

Every query reads the given tables (or files Spark writes from them) whole. Money sums
are rounded to 2 decimals and ratios to 9 on both sides so that the summation order of
two engines cannot change the compared value; ties are always broken by the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import normalize_names
from quarry.operators import charts as C
from quarry.operators import clean as CL
from quarry.operators import filters as FL
from quarry.operators import profile as P
from quarry.operators.derive import chart_product, convention_columns, product_columns
from quarry.operators.kpi import grouped_kpi, kpis
from quarry.plans.plan import plan_frame, recommend_plan, run_plan
from quarry.session import scratch_dir
from quarry.sources import sinks
from quarry.sources.delimited import read_delimited


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _r2(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 2)


def _r9(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


# =============================================================================
# charts
# =============================================================================

def bar_sum_top10(spark, d):
    t = C.bar(_t(spark, d, "lineitem"), "l_suppkey", "l_extendedprice")
    return t.select("x", _r2("y").alias("y"))


def bar_count_top10(spark, d):
    return C.bar(_t(spark, d, "part"), "p_brand")


def time_series_raw(spark, d):
    t = C.time_series(_t(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return t.select("x", _r2("y").alias("y"))


def time_series_text_dates(spark, d):
    """A13 over a text date column: parsed first, then grouped."""
    o = _t(spark, d, "orders").select(
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_date"), "o_totalprice")
    t = C.time_series(o, "order_date", "o_totalprice")
    return t.select("x", _r2("y").alias("y"))


def histogram_text(spark, d):
    """A15 / L16 on a text column: counts per value."""
    return C.histogram(_t(spark, d, "customer"), "c_mktsegment")


def time_series_day(spark, d):
    t = C.time_series(_t(spark, d, "events"), "ts", "value", grain="day")
    return t.select("x", _r2("y").alias("y"))


def histogram_20(spark, d):
    t = C.histogram(_t(spark, d, "events"), "value")
    return t.select("bin", _r9("bin_lo").alias("bin_lo"), _r9("bin_hi").alias("bin_hi"), "count")


def scatter_points(spark, d):
    return C.scatter(_t(spark, d, "part"), "p_size", "p_retailprice")


def heatmap_corr(spark, d):
    t = C.correlation(_t(spark, d, "lineitem"))
    return t.select("col_x", "col_y", _r9("corr").alias("corr"))


def pie_count_top8(spark, d):
    t = C.pie(_t(spark, d, "part"), "p_type")
    return t.select("x", "y", _r9("share").alias("share"))


def pie_sum_first8(spark, d):
    t = C.pie(_t(spark, d, "customer"), "c_nationkey", "c_acctbal")
    return t.select("x", _r2("y").alias("y"), _r9("share").alias("share"))


def funnel(spark, d):
    t = C.funnel(_t(spark, d, "events"), "event_type", "value")
    return t.select("x", _r2("y").alias("y"))


def preview(spark, d):
    return C.preview(_t(spark, d, "nation"), ["n_nationkey"])


def value_frequencies(spark, d):
    return C.value_frequencies(_t(spark, d, "part"), "p_name")


# =============================================================================
# filters
# =============================================================================

def filter_date_last90(spark, d):
    li = _t(spark, d, "lineitem")
    f, _ = FL.apply_filters(li, [{"name": "Ship date", "column": "l_shipdate", "type": "date", "importance": 1}])
    return f


def filter_in_default5(spark, d):
    o = _t(spark, d, "orders")
    f, _ = FL.apply_filters(o, [{"name": "Priority", "column": "o_orderpriority", "type": "multiselect"}])
    return f


def filter_in_top100(spark, d):
    c = _t(spark, d, "customer")
    f, _ = FL.apply_filters(c, [{"name": "Customer", "column": "c_name", "type": "multiselect"}])
    return f


def filter_range_p1_p99(spark, d):
    li = _t(spark, d, "lineitem")
    f, _ = FL.apply_filters(li, [{"name": "Price", "column": "l_extendedprice", "type": "slider"}])
    return f


def filter_equals(spark, d):
    ev = _t(spark, d, "events")
    spec = {"name": "Type", "column": "event_type", "type": "selectbox"}
    opts = FL.selectbox_options(ev, "event_type")
    f, _ = FL.apply_filters(ev, [spec], {"Type": opts[1]})
    return f


def filters_user_selection(spark, d):
    """F1 / F3 / F5 with the user's choices instead of the defaults."""
    import datetime as _dt
    li = _t(spark, d, "lineitem")
    specs = [
        {"name": "Ship date", "column": "l_shipdate", "type": "date", "importance": 3},
        {"name": "Flags", "column": "l_returnflag", "type": "multiselect", "importance": 2},
        {"name": "Quantity", "column": "l_quantity", "type": "slider", "importance": 1},
    ]
    chosen = {"Ship date": (_dt.date(1997, 1, 1), _dt.date(1998, 6, 30)), "Flags": ["A", "R"],
              "Quantity": (10.0, 30.0)}
    f, _ = FL.apply_filters(li, specs, chosen)
    return f


def filter_options_top50(spark, d):
    return C.value_frequencies(_t(spark, d, "part"), "p_name", FL.SELECTBOX_MAX_OPTIONS)


def filters_conjunction(spark, d):
    o = _t(spark, d, "orders")
    specs = [
        {"name": "Order date", "column": "o_orderdate", "type": "date", "importance": 10},
        {"name": "Priority", "column": "orderpriority", "type": "multiselect", "importance": 9},
        {"name": "Total", "column": "o_totalprice", "type": "slider", "importance": 8},
    ]
    f, _ = FL.apply_filters(o, specs)
    return f


# =============================================================================
# KPIs and derived columns
# =============================================================================

# (name, formula, decimals) over lineitem; the formulas follow what plans carry.
KPI_SCALARS = [
    ("Total price", "df['l_extendedprice'].sum()", 2),
    ("Mean quantity", "df['l_quantity'].mean()", 6),
    ("Orders", "df['l_orderkey'].nunique()", 0),
    ("Price per line", "df['l_extendedprice'].sum() / len(df)", 6),
    ("Gross", "(df['l_quantity'] * df['l_extendedprice']).sum()", -2),  # ~1e12: compare to hundreds
    ("Top price", "df['extendedprice'].max()", 2),
    ("Return share", "(df['l_returnflag'] == 'R').mean()", 9),
    ("Discounted lines", "len(df[df['l_discount'] > 0.05])", 0),
    ("Tax spread", "df['l_tax'].std()", 9),
    ("Median quantity", "df['l_quantity'].median()", 6),
    ("Free text", "open('x')", 0),
]


def kpi_scalars(spark, d):
    li = _t(spark, d, "lineitem")
    specs = [{"name": n, "formula": f, "importance": len(KPI_SCALARS) - i} for i, (n, f, _) in enumerate(KPI_SCALARS)]
    scal, _ = kpis(li, specs)
    dec = {n: k for n, _, k in KPI_SCALARS}
    rounded = F.lit(None).cast("double")
    for n, k in dec.items():
        rounded = F.when(F.col("name") == n, F.round("value", k)).otherwise(rounded)
    return scal.select("rank", "name", rounded.alias("value"), "status")


def kpi_grouped(spark, d):
    g = grouped_kpi(_t(spark, d, "customer"), "df.groupby('c_mktsegment')['c_acctbal'].sum()", "Balance by segment")
    return g.select("name", "key", _r2("value").alias("value"))


def kpi_grouped_median(spark, d):
    """A12 with a median: exact per segment, no segment held in one task."""
    g = grouped_kpi(_t(spark, d, "customer"), "df.groupby('c_mktsegment')['c_acctbal'].median()", "Median balance")
    return g.select("name", "key", F.round("value", 6).alias("value"))


KPI_FORMATTED = [
    ("Balance", "df['c_acctbal'].sum()"),
    ("Customers", "len(df)"),
    ("Mean balance", "df['c_acctbal'].mean()"),
    ("Lowest balance", "df['c_acctbal'].min()"),
    ("Nations", "df['c_nationkey'].nunique()"),
    ("Scaled", "len(df) * 1000000"),
]


def kpi_formatted(spark, d):
    specs = [{"name": n, "formula": f, "importance": len(KPI_FORMATTED) - i} for i, (n, f) in enumerate(KPI_FORMATTED)]
    scal, _ = kpis(_t(spark, d, "customer"), specs)
    return scal.select("rank", "name", "formatted")


def derived_convention(spark, d):
    li = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("unitprice"))
    out = convention_columns(li)
    return out.select("l_orderkey", "l_linenumber", "quantity", "unitprice",
                      _r2("total_sales").alias("total_sales"), _r2("revenue").alias("revenue"))


def derived_product(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    plan_texts = ["(df['l_quantity'] * df['l_extendedprice']).sum()"]
    out = product_columns(li, plan_texts)
    out, name = chart_product(out, "(df['quantity'] * df['price'])")
    return out.select("l_orderkey", "l_linenumber",
                      _r2("l_quantity_l_extendedprice_product").alias("l_quantity_l_extendedprice_product"),
                      _r2(name).alias("l_quantity_x_l_extendedprice"))


# =============================================================================
# profile
# =============================================================================

def _profile_out(prof: P.Profile, table: str | None = None) -> DataFrame:
    df = prof.df.select(
        "position", "name", "type", "nulls", _r9("null_pct").alias("null_pct"), "unique", "cardinality",
        "range_min", "range_max", F.array_join("top_values", ",").alias("top_values"))
    return df if table is None else df.select(F.lit(table).alias("tbl"), "*")


def profile_events(spark, d):
    return _profile_out(P.profile(_t(spark, d, "events")))


def profile_lineitem(spark, d):
    return _profile_out(P.profile(_t(spark, d, "lineitem")))


def profile_documents(spark, d):
    """Whole texts (up to 20,000 words, with exact copies) as group keys of the distinct count."""
    return _profile_out(P.profile(_t(spark, d, "documents")))


def profile_conversations(spark, d):
    return _profile_out(P.profile(_t(spark, d, "conversations")))


def profile_pages(spark, d):
    return _profile_out(P.profile(_t(spark, d, "pages")))


def _customer_with_nulls(spark, d) -> DataFrame:
    c = _t(spark, d, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 9 == 0, None).otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 10 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.lit(None).cast("string").alias("c_comment"),
        F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("no").alias("c_active"),
    )


def profile_customer_nulls(spark, d):
    return _profile_out(P.profile(_customer_with_nulls(spark, d)))


def profile_top3(spark, d):
    """A5: the three most frequent values of each categorical column, as the profile found them."""
    rows = []
    for table in ("orders", "customer"):
        prof = P.profile(_t(spark, d, table))
        for c in prof.columns:
            for rk, (v, n) in enumerate(zip(c.get("top_values") or [], c.get("top_counts") or []), start=1):
                rows.append((table, c["name"], rk, v, n))
    return spark.createDataFrame(rows, "tbl string, name string, rk int, v string, cnt bigint")


def profile_sample3(spark, d):
    return P.sample_rows(_t(spark, d, "customer"), ["c_custkey"])


# =============================================================================
# ingest, cleaning, sinks
# =============================================================================

def csv_roundtrip(spark, d):
    ev = _t(spark, d, "events")
    path = scratch_dir(spark, "csv-roundtrip")
    sinks.write_clean(ev, path, fmt="csv", sep="|")
    return read_delimited(spark, path).df


_EVENT_HEAD = "event_id,ts,user_id,event_type,value,props"


def _raw_lines(df, header: str, path: str) -> str:
    """Lines as they are, each part file under its own header."""
    w = df.toDF(header).write.option("header", True).option("sep", "\u0001\u0002").option("quote", "").option("escape", "")
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _event_line(*more):
    """One event as a line with all its columns; props holds inner quotes, left unquoted."""
    return F.concat_ws(",", "event_id", F.col("ts").cast("string"), "user_id", "event_type", "value", "props", *more)


def _bad_rows_dir(spark, d) -> str:
    ev = _t(spark, d, "events")
    k = F.col("event_id") % 100
    short = F.concat_ws(",", "event_id", F.col("ts").cast("string"), "user_id", "event_type")
    line = F.when(k == 0, _event_line(F.lit("x"))).when(k == 1, short).otherwise(_event_line())
    return _raw_lines(ev.select(line), _EVENT_HEAD, scratch_dir(spark, "csv-bad-rows"))


def csv_bad_rows(spark, d):
    return read_delimited(spark, _bad_rows_dir(spark, d), sep=",").df


def csv_rejects(spark, d):
    return read_delimited(spark, _bad_rows_dir(spark, d), sep=",").rejects.drop("file", "line_number")


def csv_reject_lines(spark, d):
    """Where the rejected lines stand. Eight files of events, each in the order of its ids."""
    ev = _t(spark, d, "events").withColumn("part", F.col("event_id") % 8)
    k = F.col("event_id") % 100
    line = F.when(k == 0, _event_line(F.lit("x"))).when(k == 1, F.concat_ws(",", "event_id", "user_id")).otherwise(_event_line())
    path = scratch_dir(spark, "csv-reject-lines")
    rows = ev.select("part", "event_id", line.alias(_EVENT_HEAD)).repartition("part").sortWithinPartitions("part", "event_id").drop("event_id")
    w = rows.write.partitionBy("part").option("header", True).option("sep", "\u0001\u0002").option("quote", "").option("escape", "")
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rejects = read_delimited(spark, path, sep=",", strict=True, promote=False).rejects
    return rejects.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), "line_number", "expected", "found")


def csv_headers_by_name(spark, d):
    """Every other order in files whose columns stand in another order, with one more."""
    o = _t(spark, d, "orders")
    base, odd = scratch_dir(spark, "csv-headers-by-name"), F.col("o_orderkey") % 2 == 1
    sinks.write_clean(o.where(~odd).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), f"{base}/a", fmt="csv")
    sinks.write_clean(o.where(odd).select("o_orderdate", "o_custkey", "o_totalprice", "o_orderkey", "o_orderstatus"), f"{base}/b", fmt="csv")
    return read_delimited(spark, [f"{base}/a", f"{base}/b"]).df


def csv_line_breaks(spark, d):
    """Documents with line breaks in a file that is read by lines: no fragment of a text
    is a row, and every line of it is among the rejects."""
    path = scratch_dir(spark, "csv-line-breaks")
    sinks.write_clean(_t(spark, d, "documents"), path, fmt="csv")
    ing = read_delimited(spark, path, sep=",", promote=False)
    rejected = ing.rejects.count()
    return ing.df.withColumn("rejected", F.lit(rejected).cast("long"))


def csv_latin1(spark, d):
    """S3: whole documents, those that ISO-8859-1 can hold in files of that encoding, the others
    in UTF-8 files beside them."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    latin = F.coalesce(~F.col("text").rlike("[^\\u0000-\\u00FF]"), F.lit(True))
    base = scratch_dir(spark, "csv-latin1")
    for name, part in (("ISO-8859-1", docs.where(latin)), ("UTF-8", docs.where(~latin))):
        (part.write.option("header", True).option("encoding", name).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{name}"))
    return read_delimited(spark, [f"{base}/ISO-8859-1", f"{base}/UTF-8"], sep=",", multiline=True).df


def normalize_names_q(spark, d):
    c = _t(spark, d, "customer").toDF("C. CustKey ", " C. Name", "C. Nation Key", "C Acct.Bal", "C. MktSegment")
    clean, _ = normalize_names(c.columns)
    return c.toDF(*clean)


def promote_dates(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate"))
    out, _ = CL.promote_types(o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderdate"))
    return out


def promote_numbers(spark, d):
    c = _t(spark, d, "customer")
    money = F.concat(F.lit("$"), F.format_number("c_acctbal", 2))
    txt = c.select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.when(F.col("c_custkey") % 10 == 0, None).otherwise(money).alias("c_acctbal"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("%")).alias("c_nationkey"),
        F.col("c_name"),
    )
    out, _ = CL.promote_types(txt)
    return out


def drop_empty_rows_q(spark, d):
    c = _t(spark, d, "customer")
    gone = F.col("c_custkey") % 7 == 0
    blanked = c.select(*[F.when(gone, None).otherwise(F.col(n)).alias(n) for n in c.columns])
    return CL.drop_empty_rows(blanked)


def drop_empty_columns_q(spark, d):
    return CL.drop_empty_columns(_customer_with_nulls(spark, d))


def majority_numeric(spark, d):
    p = _t(spark, d, "part")
    code = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("A"))) \
        .otherwise(F.col("p_partkey").cast("string"))
    return CL.display_prep(p.select("p_partkey", code.alias("p_code"), "p_brand"))


def display_text(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    src = o.select(
        "o_orderkey",
        F.when(k % 11 == 0, None).otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "nan").when(k % 5 == 2, "None")
        .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ship_date"),
        F.lit(None).cast("double").alias("o_unused"),
    )
    return CL.display_prep(src)


def export_filtered(spark, d):
    li = _t(spark, d, "lineitem")
    f, _ = FL.apply_filters(li, [{"name": "Flag", "column": "l_returnflag", "type": "selectbox"}], {"Flag": "R"})
    path = scratch_dir(spark, "export")
    sinks.export_filtered(f, path)
    return read_delimited(spark, path).df


def empty_input(spark, d):
    """A filter that no row meets: an empty profile, and panels without rows."""
    c = _t(spark, d, "customer").where(F.col("c_acctbal") > 1e12)
    prof = P.profile(c)
    assert prof.rows == 0 and prof.df.schema == P.PROFILE_SCHEMA
    plan = {"charts": [
        {"name": "Balance by segment", "type": "bar", "x_column": "c_mktsegment", "y_column": "c_acctbal"},
        {"name": "Balance", "type": "histogram", "x_column": "c_acctbal"},
        {"name": "Nations", "type": "pie", "x_column": "c_nationkey", "y_column": "c_acctbal"},
        {"name": "Funnel", "type": "funnel", "x_column": "c_mktsegment", "y_column": "c_acctbal"},
        {"name": "Heat", "type": "heatmap"},
    ]}
    shown = run_plan(c, plan).panels()
    return shown.groupBy().agg(F.count("*").alias("rows"), F.lit(c.count()).cast("long").alias("kept"))


def spec_roundtrip(spark, d):
    prof = P.profile(_t(spark, d, "customer"))
    base = scratch_dir(spark, "specs")
    sinks.write_profile(prof.df, f"{base}/profile")
    return _profile_out(P.Profile(prof.rows, prof.columns, sinks.read_profile(spark, f"{base}/profile")))


def plan_roundtrip(spark, d):
    """The recommended plan of orders, written and read back, as rows."""
    prof = P.profile(_t(spark, d, "orders"))
    path = scratch_dir(spark, "plan")
    sinks.write_plan(spark, recommend_plan(prof.columns), path)
    return plan_frame(spark, sinks.read_plan(spark, path))


def metadata_roundtrip(spark, d):
    """The counts of a load, written and read back."""
    path = scratch_dir(spark, "meta")
    ing = read_delimited(spark, _bad_rows_dir(spark, d), sep=",")
    sinks.write_load(spark, ing, path)
    m = sinks.read_metadata(spark, f"{path}/metadata")
    assert m["load_timestamp"]
    cols = ["delimiter", "encoding", "rows", "columns", "rejects"]
    return spark.createDataFrame(
        [(m["delimiter"], m["encoding_used"], m["original_shape"][0], m["original_shape"][1], m["errors_found"])],
        f"{cols[0]} string, {cols[1]} string, {cols[2]} long, {cols[3]} long, {cols[4]} long")


def reload_with_fallback(spark, d):
    """A whole load comes back by its manifest, a torn one from its source."""
    o = _t(spark, d, "orders")
    source, base = scratch_dir(spark, "reload-source"), scratch_dir(spark, "reload")
    sinks.write_clean(o, source, fmt="csv")
    sinks.write_load(spark, read_delimited(spark, source), f"{base}/whole")
    meta = sinks.write_load(spark, read_delimited(spark, source), f"{base}/torn")
    sinks.write_clean(o.where("o_orderkey % 2 = 0"), f"{base}/torn/clean")  # half of its rows are gone
    out = None
    for name in ("whole", "torn"):
        df, told, how = sinks.read_load(spark, f"{base}/{name}", source)
        df = df.withColumns({"load": F.lit(name), "by": F.lit(how), "rows": F.lit(meta["processed_shape"][0]).cast("long"), "sep": F.lit(told["delimiter"])})
        out = df if out is None else out.unionByName(df)
    return out


def csv_documents(spark, d):
    """Whole documents, line breaks and blanks at the ends included, through the CSV sink."""
    path = scratch_dir(spark, "csv-documents")
    sinks.write_clean(_t(spark, d, "documents"), path, fmt="csv")
    return sinks.read_clean(spark, path, fmt="csv")


def csv_long_ids(spark, d):
    """Keys of 19 and of 22 digits keep every digit."""
    o = _t(spark, d, "orders")
    path = scratch_dir(spark, "csv-long-ids")
    wide = F.lit("1234567890123456789000").cast("decimal(38,0)")
    src = o.select((F.col("o_orderkey") + F.lit(1234567890123456789)).alias("id"), (F.col("o_orderkey") + wide).cast("string").alias("wide"))
    sinks.write_clean(src, path, fmt="csv")
    return read_delimited(spark, path).df


def csv_quotes(spark, d):
    """Events with inner quotes that the writer left unquoted."""
    path = _raw_lines(_t(spark, d, "events").select(_event_line()), _EVENT_HEAD, scratch_dir(spark, "csv-quotes"))
    return read_delimited(spark, path, sep=",").df


def csv_strict(spark, d):
    """Only records with exactly the header's fields."""
    return read_delimited(spark, _bad_rows_dir(spark, d), sep=",", strict=True).df


def csv_many_headers(spark, d):
    """Files that spell the header differently, and a row that equals one of them."""
    c = _t(spark, d, "customer")
    base = scratch_dir(spark, "csv-headers")
    row = F.concat_ws(",", "c_custkey", "c_name")
    odd = F.col("c_custkey") % 2 == 1
    _raw_lines(c.where(~odd).select(F.when(F.col("c_custkey") == 10, F.lit("key,name")).otherwise(row)), "key,name", f"{base}/a")
    _raw_lines(c.where(odd).select(row), '"key","name"', f"{base}/b")
    return read_delimited(spark, [f"{base}/a", f"{base}/b"], promote=False).df


def csv_tokens(spark, d):
    """Every missing-value token in a column becomes NULL."""
    from quarry.functions.tokens import NA_TOKENS
    words = F.array(*(F.lit(t) for t in NA_TOKENS))
    c = _t(spark, d, "customer")
    token = F.get(words, (F.col("c_custkey") % len(NA_TOKENS)).cast("int"))
    path = scratch_dir(spark, "csv-tokens")
    line = F.concat_ws(",", "c_custkey", F.when(F.col("c_custkey") % 2 == 0, token).otherwise(F.col("c_mktsegment")))
    return read_delimited(spark, _raw_lines(c.select(line), "c_custkey,c_mktsegment", path)).df


_BIG = 4_000_000_000_000_000_000


def bar_sum_wide(spark, d):
    """Totals beyond a long."""
    li = _t(spark, d, "lineitem").select("l_returnflag", (F.col("l_partkey") + F.lit(_BIG)).alias("big"))
    return C.bar(li, "l_returnflag", "big").select("x", F.col("y").cast("string").alias("y"))


def kpi_sum_wide(spark, d):
    li = _t(spark, d, "lineitem").select((F.col("l_partkey") + F.lit(_BIG)).alias("big"))
    scal, _ = kpis(li, [{"name": "Big", "formula": "df['big'].sum()", "importance": 1}])
    return scal.select("name", "value", "status")


def kpi_product_wide(spark, d):
    """Row arithmetic on whole numbers whose results need more than an int, more than a long."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.lit(_BIG)).alias("big"))
    part = _t(spark, d, "part").select("p_partkey", (F.col("p_size") * 1000000).cast("int").alias("size"), (1_900_000_000 + F.col("p_partkey") % 100_000_000).cast("int").alias("wide"))
    specs = lambda forms: [{"name": f, "formula": f, "importance": 9 - i} for i, f in enumerate(forms)]
    a, _ = kpis(li, specs(["(df['big'] + df['big']).sum()", "(df['big'] * df['l_linenumber']).max()", "(df['big'] * df['big']).mean()", "(df['big'] * df['big']).sum()"]))
    b, _ = kpis(part, specs(["(df['wide'] * df['size']).sum()", "(df['wide'] * 1000 - df['size'] * df['wide'] * 7).min()", "(-df['wide'] * df['wide']).mean()"]))
    # totals beyond a double's digits: compared as 7 significant ones
    return a.unionByName(b).select("name", F.format_string("%.6e", "value").alias("value"), "status")


def kpi_nested(spark, d):
    """Reductions of grouped results."""
    o = _t(spark, d, "orders")
    scal, _ = kpis(o, [
        {"name": "Mean per customer", "formula": "df.groupby('o_custkey')['o_totalprice'].sum().mean()", "importance": 3},
        {"name": "Largest status", "formula": "df['o_orderstatus'].value_counts().max()", "importance": 2},
    ])
    return scal.select("rank", "name", _r2("value").alias("value"), "status")


def _forms(df, formulas, order_by=None):
    """Formulas as KPIs in that order: rank, value (rounded), text (of results that are no number), status."""
    scal, _ = kpis(df, [{"name": f, "formula": f, "importance": 99 - i} for i, f in enumerate(formulas)], order_by)
    text = F.when(F.col("value").isNull(), F.col("formatted"))
    return scal.select("rank", F.round("value", 4).alias("value"), text.alias("text"), "status")


def kpi_running(spark, d):
    """A11 over ordered rows: orders by their key."""
    return _forms(_t(spark, d, "orders"), [
        "df['o_custkey'].cumsum().max()", "df['o_totalprice'].diff().mean()", "df['o_totalprice'].pct_change().max()", "df['o_totalprice'].rolling(7).mean().max()",
        "df[df['o_orderstatus'] == 'F']['o_totalprice'].rolling(30).sum().min()", "df['o_custkey'].shift(3).sum()", "df['o_totalprice'].cummax().mean()",
    ], ["o_orderkey"])


def kpi_best(spark, d):
    """A11 whose result is a row's or a group's key, and sums of the largest values."""
    return _forms(_t(spark, d, "orders"), [
        "df.loc[df['o_totalprice'].idxmax(), 'o_orderpriority']", "df.loc[df['o_totalprice'].idxmin(), 'o_orderkey']", "df['o_totalprice'].nlargest(10).sum()",
        "df['o_totalprice'].nsmallest(25).mean()", "df['o_orderstatus'].mode()[0]", "df['o_custkey'].value_counts().idxmax()", "df['o_orderpriority'].value_counts().iloc[0]",
        "df.groupby('o_orderpriority')['o_totalprice'].sum().idxmax()", "df.groupby('o_custkey')['o_totalprice'].mean().idxmin()",
    ])


def kpi_group_keys(spark, d):
    """A12 by several columns, by parts of a time, by periods with the empty ones."""
    li = _t(spark, d, "lineitem")
    forms = [
        "df.groupby(['l_returnflag', 'l_linestatus'])['l_quantity'].sum()", "df.groupby(df['l_shipdate'].dt.month)['l_extendedprice'].mean()", "df.groupby('l_linenumber').size()",
        "df.groupby('l_returnflag').agg({'l_tax': 'max'})", "df[df['l_quantity'] > 49].resample('ME', on='l_shipdate')['l_extendedprice'].sum()",
        "df[df['l_suppkey'] == 7].resample('D', on='l_shipdate').size()",
    ]
    parts = [grouped_kpi(li, f, str(i)) for i, f in enumerate(forms)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("name", "key", _r2("value").alias("value"))


def kpi_typed(spark, d):
    """U1 over times and texts."""
    orders = _forms(_t(spark, d, "orders"), [
        "df['o_orderdate'].dt.year.nunique()", "(df['o_orderdate'].dt.dayofweek >= 5).mean()", "(df['o_orderdate'].max() - df['o_orderdate'].min()).days",
        "df['o_orderpriority'].str.contains('URGENT').sum()", "len(df[df['o_orderpriority'].str.startswith('1')])", "np.where(df['o_totalprice'] > 100000, df['o_totalprice'], 0).sum()",
        "df['o_totalprice'].astype(int).sum()",
    ])
    docs = _forms(_t(spark, d, "documents"), ["df['text'].str.len().max()", "df['source'].str.upper().nunique()", "(df['text'].str.len() - df['n_chars']).abs().sum()", "df['text'].str.contains('the', case=False).mean()"])
    return orders.withColumn("rank", F.col("rank").cast("int")).unionByName(docs.withColumn("rank", (F.col("rank") + 100).cast("int")))


def kpi_first(spark, d):
    """A11 over first rows: of several that share a key, the first in the order of the line."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    return _forms(li, [
        "df['l_suppkey'].duplicated().sum()", "df.duplicated(subset=['l_orderkey', 'l_suppkey']).sum()", "df.drop_duplicates(['l_suppkey'])['l_quantity'].sum()",
        "df.drop_duplicates(subset=['l_returnflag', 'l_linenumber'])['l_quantity'].max()", "len(df.drop_duplicates(['l_returnflag']))", "len(df) - df.duplicated().sum()",
    ], ["l_orderkey", "l_linenumber"])


def kpi_moments(spark, d):
    """Higher moments, two columns at once, ranks."""
    return _forms(_t(spark, d, "lineitem"), [
        "df['l_quantity'].corr(df['l_extendedprice'])", "df['l_quantity'].cov(df['l_tax'])", "df['l_extendedprice'].skew()", "df['l_extendedprice'].kurt()", "(df['l_discount'] * 0 + 1).prod()",
        "df['l_tax'].sem()", "np.percentile(df['l_extendedprice'], 90)", "df['l_extendedprice'].quantile(0.25)", "df['l_quantity'].median()",
    ])


def kpi_masks(spark, d):
    """Row-wise methods inside masks and arguments."""
    o = _t(spark, d, "orders")
    forms = [
        "df['o_orderstatus'].isin(['F', 'P']).sum()", "df[df['o_totalprice'].between(1000, 50000)]['o_totalprice'].sum()",
        "df['o_orderpriority'].isna().sum()", "df[df['o_custkey'].notna()]['o_custkey'].nunique()", "df['o_totalprice'].quantile(0.9)",
        "len(df['o_orderpriority'].unique())", "round(df['o_totalprice'].mean(), 1)", "df['o_totalprice'].fillna(0).min()",
    ]
    scal, _ = kpis(o, [{"name": str(i), "formula": f, "importance": 99 - i} for i, f in enumerate(forms)])
    return scal.select("rank", _r2("value").alias("value"), "status")


def derived_int_product(spark, d):
    """P10 over int columns whose products need a long, at any scale."""
    wide = 1_900_000_000 + F.col("p_partkey") % 100_000_000
    p = _t(spark, d, "part").select("p_partkey", wide.cast("int").alias("quantity"), (F.col("p_size") * 1000000).cast("int").alias("unitprice"))
    return convention_columns(p).select("p_partkey", F.col("total_sales").cast("string").alias("total_sales"))


def plan_text_numbers(spark, d):
    """U2 over prices that came as text: the KPI and the chart add them up as numbers."""
    price = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    o = _t(spark, d, "orders").select("o_orderpriority", price.alias("price"))
    plan = {
        "kpis": [{"name": "Total", "formula": "df['price'].sum()", "importance": 1}],
        "charts": [{"name": "By priority", "type": "bar", "x_column": "o_orderpriority", "y_column": "price"}],
    }
    db = run_plan(o, plan)
    return db.kpis.select("name", F.lit(None).cast("string").alias("x"), _r2("value").alias("y")).unionByName(
        db.panels().select(F.col("panel").alias("name"), "x", _r2("y").alias("y")))


def _events_nan(spark, d):
    return _t(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))


def profile_nan(spark, d):
    return _profile_out(P.profile(_events_nan(spark, d)))


def profile_infinite(spark, d):
    """A column with an infinity has no numeric type."""
    ev = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") == 5, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    return _profile_out(P.profile(ev)).select("name", "type", "nulls")


def histogram_nan(spark, d):
    t = C.histogram(_events_nan(spark, d), "value")
    return t.select("bin", _r9("bin_lo").alias("bin_lo"), _r9("bin_hi").alias("bin_hi"), "count")


def filter_range_nan(spark, d):
    from quarry.functions.missing import without_nan
    ev = without_nan(_events_nan(spark, d))
    lo, hi = FL.slider_bounds(ev, "value")
    return ev.where(FL.range_predicate("value", lo, hi))


def promote_dates_forms(spark, d):
    """P2 over one column for each accepted way of writing a date."""
    o, t = _t(spark, d, "orders"), F.col("o_orderdate").cast("timestamp_ntz")
    forms = {
        "zulu": "yyyy-MM-dd'T'HH:mm:ss'Z'", "offset": "yyyy-MM-dd HH:mm:ss'+02:00'", "slashes": "yyyy/MM/dd", "dashes": "MM-dd-yyyy",
        "words": "MMM d, yyyy", "day_first": "d MMMM yyyy", "short": "M/d/yy", "noon": "M/d/yyyy h:mm a",
    }
    src = o.select("o_orderkey", *(F.date_format(t, f).alias(n) for n, f in forms.items()))
    return CL.promote_types(src)[0]


def promote_dates_dayfirst(spark, d):
    """P2 where the day comes first, which only the whole column shows."""
    o, t = _t(spark, d, "orders"), F.col("o_orderdate").cast("timestamp_ntz")
    src = o.select("o_orderkey", F.date_format(t, "dd/MM/yyyy").alias("day"), F.date_format(t, "d-M-yyyy HH:mm").alias("timed"), F.date_format(t, "MM/dd/yyyy").alias("month"))
    return CL.promote_types(src)[0]


def promote_dates_lenient(spark, d):
    """P2 with a few values that are no dates: they become NULL and are counted."""
    o = _t(spark, d, "orders")
    src = o.select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    failures: dict[str, int] = {}
    out, _ = CL.promote_types(src, lenient=0.9, failures=failures)
    return out.withColumn("failures", F.lit(failures["d"]).cast("long"))


def reload_clean(spark, d):
    o = _t(spark, d, "orders")
    path = scratch_dir(spark, "clean")
    sinks.write_clean(o, path)
    return sinks.read_clean(spark, path)


# =============================================================================
# plans
# =============================================================================

def recommend_plan_q(spark, d):
    prof = P.profile(_t(spark, d, "events"))
    plan = recommend_plan(prof.columns)
    return plan_frame(spark, plan)


def auto_dashboard(spark, d):
    ev = _t(spark, d, "events")
    prof = P.profile(ev)
    plan = recommend_plan(prof.columns)
    db = run_plan(ev, plan)
    return db.panels().select("panel", "kind", "rank", "x", "x2", _r9("y").alias("y"), _r9("y2").alias("y2"))


def plan_kpis(spark, d):
    """The recorded plan's KPI shapes (total, mean, grouped) over orders."""
    o = _t(spark, d, "orders")
    plan = {
        "kpis": [
            {"name": "Total Sales", "formula": "df['o_totalprice'].sum()", "importance": 10},
            {"name": "Average Order Value", "formula": "df['o_totalprice'].mean()", "importance": 9},
            {"name": "Sales by Status", "formula": "df.groupby('o_orderstatus')['o_totalprice'].sum()", "importance": 8},
        ]
    }
    db = run_plan(o, plan)
    one = db.kpis.select("rank", "name", F.lit(None).cast("string").alias("key"), _r2("value").alias("value"), "status")
    groups = db.grouped_kpis.select(F.lit(None).cast("int").alias("rank"), "name", "key", _r2("value").alias("value"), F.lit("group").alias("status"))
    return one.unionByName(groups)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bar_sum_top10": bar_sum_top10,
    "bar_count_top10": bar_count_top10,
    "time_series_raw": time_series_raw,
    "time_series_day": time_series_day,
    "time_series_text_dates": time_series_text_dates,
    "histogram_text": histogram_text,
    "histogram_20": histogram_20,
    "scatter_points": scatter_points,
    "heatmap_corr": heatmap_corr,
    "pie_count_top8": pie_count_top8,
    "pie_sum_first8": pie_sum_first8,
    "funnel": funnel,
    "preview": preview,
    "value_frequencies": value_frequencies,
    "filter_date_last90": filter_date_last90,
    "filter_in_default5": filter_in_default5,
    "filter_in_top100": filter_in_top100,
    "filter_range_p1_p99": filter_range_p1_p99,
    "filter_equals": filter_equals,
    "filters_user_selection": filters_user_selection,
    "filter_options_top50": filter_options_top50,
    "filters_conjunction": filters_conjunction,
    "kpi_scalars": kpi_scalars,
    "kpi_grouped": kpi_grouped,
    "kpi_grouped_median": kpi_grouped_median,
    "kpi_formatted": kpi_formatted,
    "plan_kpis": plan_kpis,
    "derived_convention": derived_convention,
    "derived_product": derived_product,
    "profile_events": profile_events,
    "profile_lineitem": profile_lineitem,
    "profile_customer_nulls": profile_customer_nulls,
    "profile_documents": profile_documents,
    "profile_conversations": profile_conversations,
    "profile_pages": profile_pages,
    "profile_top3": profile_top3,
    "profile_sample3": profile_sample3,
    "csv_roundtrip": csv_roundtrip,
    "csv_bad_rows": csv_bad_rows,
    "csv_rejects": csv_rejects,
    "csv_reject_lines": csv_reject_lines,
    "csv_headers_by_name": csv_headers_by_name,
    "csv_line_breaks": csv_line_breaks,
    "csv_latin1": csv_latin1,
    "normalize_names": normalize_names_q,
    "promote_dates": promote_dates,
    "promote_numbers": promote_numbers,
    "drop_empty_rows": drop_empty_rows_q,
    "drop_empty_columns": drop_empty_columns_q,
    "majority_numeric": majority_numeric,
    "display_text": display_text,
    "export_filtered": export_filtered,
    "empty_input": empty_input,
    "spec_roundtrip": spec_roundtrip,
    "plan_roundtrip": plan_roundtrip,
    "metadata_roundtrip": metadata_roundtrip,
    "reload_with_fallback": reload_with_fallback,
    "csv_documents": csv_documents,
    "csv_long_ids": csv_long_ids,
    "csv_quotes": csv_quotes,
    "csv_strict": csv_strict,
    "csv_many_headers": csv_many_headers,
    "csv_tokens": csv_tokens,
    "bar_sum_wide": bar_sum_wide,
    "kpi_sum_wide": kpi_sum_wide,
    "kpi_product_wide": kpi_product_wide,
    "kpi_nested": kpi_nested,
    "kpi_masks": kpi_masks,
    "kpi_running": kpi_running,
    "kpi_best": kpi_best,
    "kpi_group_keys": kpi_group_keys,
    "kpi_typed": kpi_typed,
    "kpi_first": kpi_first,
    "kpi_moments": kpi_moments,
    "derived_int_product": derived_int_product,
    "plan_text_numbers": plan_text_numbers,
    "profile_nan": profile_nan,
    "profile_infinite": profile_infinite,
    "histogram_nan": histogram_nan,
    "filter_range_nan": filter_range_nan,
    "promote_dates_forms": promote_dates_forms,
    "promote_dates_dayfirst": promote_dates_dayfirst,
    "promote_dates_lenient": promote_dates_lenient,
    "reload_clean": reload_clean,
    "recommend_plan": recommend_plan_q,
    "auto_dashboard": auto_dashboard,
}

"""Plans: recommendation rules, execution, sinks round trip, streaming source."""


from quarry.operators.profile import profile
from quarry.plans.auto import analyse_file, auto_dashboard
from quarry.plans.plan import recommend_plan, run_plan
from quarry.session import scratch_dir
from quarry.sources import sinks
from quarry.sources.delimited import read_delimited
from quarry.streaming import stream_delimited

from helpers import write_text

RETAIL = b"""InvoiceNo\tStockCode\tDescription\tQuantity\tInvoiceDate\tUnitPrice\tCustomerID\tCountry
536365\t85123A\tWHITE HANGING HEART\t6\t12/1/2010 8:26\t2.55\t17850\tUnited Kingdom
536365\t71053\tWHITE METAL LANTERN\t6\t12/1/2010 8:26\t3.39\t17850\tUnited Kingdom
536366\t22633\tHAND WARMER UNION JACK\t6\t12/1/2010 8:28\t1.85\t17850\tUnited Kingdom
C536379\t22632\tAIRLINE LOUNGE,METAL SIGN\t-1\t12/1/2010 9:41\t2.1\t14527\tFrance
536370\t22728\tALARM CLOCK BAKELIKE PINK\t24\t12/1/2010 8:45\t3.75\t12583\tFrance
536370\t22727\tALARM CLOCK BAKELIKE RED\t24\t12/1/2010 8:45\t3.75\t12583\tAustralia
"""


def test_retail_file_end_to_end(spark, tmp_path):
    p = write_text(tmp_path / "retail.csv", RETAIL)
    out = scratch_dir(spark, "test-analyse")
    ing, res = analyse_file(spark, p, out_dir=out, order_by=["invoiceno"])
    types = {f.name: f.dataType.simpleString() for f in ing.df.schema.fields}
    assert ing.metadata["delimiter"] == "\t"
    assert types["invoiceno"] == "string" and types["quantity"] == "bigint"
    assert types["invoicedate"] == "timestamp_ntz" and types["unitprice"] == "double"
    assert ing.df.where("description = 'AIRLINE LOUNGE,METAL SIGN'").count() == 1
    plan = res.plan
    assert [k["formula"] for k in plan["kpis"]] == ["df['quantity'].sum()", "df['unitprice'].mean()"]
    db = res.dashboard
    # P10: quantity * unitprice -> total_sales and revenue
    assert {"total_sales", "revenue"} <= set(db.filtered.columns)
    back = sinks.read_profile(spark, f"{out}/profile")
    assert back.count() == len(ing.df.columns)
    assert sinks.read_plan(spark, f"{out}/plan")["charts"][0]["type"] == "time_series"
    meta = sinks.read_metadata(spark, f"{out}/metadata")
    assert meta["original_shape"] == [6, 8] and meta["errors_found"] == 0


def test_recorded_plan_runs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = {
        "kpis": [{"name": "Total", "formula": "df['o_totalprice'].sum()", "importance": 10},
                 {"name": "By status", "formula": "df.groupby('o_orderstatus')['o_totalprice'].sum()",
                  "importance": 8}],
        "charts": [
            {"name": "Trend", "importance": 10, "type": "time_series", "x_column": "o_orderdate",
             "y_column": "totalprice"},
            {"name": "Pie", "importance": 8, "type": "pie", "x_column": "orderstatus", "y_column": "o_totalprice"},
            {"name": "Hist", "importance": 8, "type": "histogram", "x_column": "o_totalprice"},
            {"name": "Odd", "importance": 1, "type": "sankey", "x_column": "o_orderkey"},
            {"name": "Gone", "importance": 1, "type": "bar", "x_column": "nothing_like_it"},
        ],
        "filters": [{"name": "Date", "column": "o_orderdate", "type": "date", "importance": 10},
                    {"name": "Status", "column": "o_orderstatus", "type": "multiselect", "importance": 9}],
    }
    db = run_plan(o, plan)
    assert db.chart_status["Odd"] == "preview" and db.chart_status["Gone"].startswith("error: no column")
    kinds = {r["kind"] for r in db.panels().select("kind").distinct().collect()}
    assert kinds == {"time_series", "pie", "histogram", "preview", "error"}
    shares = db.charts["Pie"].agg({"y2": "sum"}).first()[0]
    assert abs(shares - 1.0) < 1e-9
    hist = db.charts["Hist"].agg({"y": "sum"}).first()[0]
    assert hist == db.filtered.count()
    assert db.grouped_kpis.count() == o.select("o_orderstatus").distinct().count()
    assert not db.is_empty()
    none = run_plan(o, plan, selections={"Status": ["no such status"]})
    assert none.is_empty() and none.panels().count() >= 0


def test_recommend_rules_names():
    cols = [
        {"position": 0, "name": "order_timestamp", "type": "datetime"},
        {"position": 1, "name": "order_amount_usd", "type": "float"},
        {"position": 2, "name": "qty", "type": "integer"},
        {"position": 3, "name": "channel", "type": "categorical"},
    ]
    p = recommend_plan(cols)
    assert p["kpis"][0]["name"] == "Total Order_Amount_Usd"
    assert [c["type"] for c in p["charts"]] == ["time_series", "bar", "histogram", "scatter"]
    assert [f["type"] for f in p["filters"]] == ["date", "multiselect"]
    assert recommend_plan([{"position": 0, "name": "t", "type": "text"}])["charts"] == []


def test_auto_dashboard_events(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    res = auto_dashboard(ev)
    assert [c["type"] for c in res.profile.columns] == ["integer", "datetime", "integer", "categorical", "float",
                                                        "categorical"]
    assert res.dashboard.filtered.count() == ev.count()


def test_stream_delimited(spark, tmp_path):
    src = tmp_path / "landing"
    src.mkdir()
    write_text(src / "a.csv", b"a,b\n1,x\n2,y,z\n\n3,NA\n")
    sdf = stream_delimited(spark, str(src), header="a,b")
    q = sdf.writeStream.format("memory").queryName("quarry_stream_test").outputMode("append").start()
    try:
        q.processAllAvailable()
        rows = sorted(tuple(r) for r in spark.sql("select * from quarry_stream_test").collect())
    finally:
        q.stop()
    assert rows == [("1", "x"), ("3", None)]


def test_profile_of_ingested_matches_reload(spark, sf_dir, tmp_path):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    path = scratch_dir(spark, "test-reload")
    sinks.write_clean(o, path, fmt="csv")
    back = read_delimited(spark, path).df
    assert [f.dataType.simpleString() for f in back.schema.fields] == \
        [f.dataType.simpleString() for f in o.schema.fields]
    assert back.exceptAll(o).count() == 0 and o.exceptAll(back).count() == 0
    assert [c["type"] for c in profile(back).columns] == [c["type"] for c in profile(o).columns]


def test_partitioned_clean_write_and_export_count(spark, sf_dir):
    from pyspark.sql import functions as F
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = scratch_dir(spark, "test-sinks")
    sinks.write_clean(o.withColumn("o_year", F.year("o_orderdate")), f"{base}/clean", partition_by=["o_year"])
    back = sinks.read_clean(spark, f"{base}/clean")
    assert back.count() == o.count()
    pruned = back.where("o_year = 1995")
    assert pruned.count() == o.where(F.year("o_orderdate") == 1995).count()
    n = sinks.export_filtered(o.where("o_orderstatus = 'F'"), f"{base}/export")
    assert n == o.where("o_orderstatus = 'F'").count()
    assert read_delimited(spark, f"{base}/export").df.count() == n


def test_run_plan_checkpointed(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = recommend_plan(profile(ev).columns)
    a = run_plan(ev, plan)
    b = run_plan(ev, plan, materialize="checkpoint")
    assert b.filtered.count() == a.filtered.count()
    pa = sorted(tuple(r) for r in a.panels().collect())
    pb = sorted(tuple(r) for r in b.panels().collect())
    assert pa == pb


def test_cli(spark, tmp_path, capsys):
    from quarry.__main__ import main
    assert main([str(tmp_path / "none.csv")]) == 1
    p = write_text(tmp_path / "c.csv", b"Order ID,Order Date,Qty\n1,01/05/2024,2\n2,01/06/2024,\n")
    assert main([p]) == 0
    out = capsys.readouterr().out
    assert "orderdate" in out and "Total Orderid" in out

"""Profile: type rules, counts, top values, sample rows."""

import math

from pyspark.sql import functions as F

from quarry.operators.profile import PROFILE_SCHEMA, profile, sample_rows, summary


def _types(spark, rows, ddl):
    p = profile(spark.createDataFrame(rows, ddl))
    return {c["name"]: c for c in p.columns}


def test_a7_rules(spark):
    rows = [("yes", "TRUE", f"id{i}", "x" * 60, "2024-01-0" + str(i % 9 + 1), "$1,0" + str(i), "a" if i % 2 else "b")
            for i in range(10)]
    cols = _types(spark, rows, "yn string, tf string, ids string, long string, d string, n string, cat string")
    assert cols["yn"]["type"] == "boolean"
    assert cols["tf"]["type"] == "boolean"
    assert cols["ids"]["type"] == "text"
    assert cols["long"]["type"] == "text"
    assert cols["d"]["type"] == "datetime"
    assert cols["n"]["type"] == "numeric_string"
    assert cols["cat"]["type"] == "categorical"
    assert cols["cat"]["top_values"] == ["a", "b"]  # equal counts: value ascending (L20)


def test_fixture_a7_mixed_true_false(spark):
    cols = _types(spark, [("TRUE",), ("False",), ("t",), ("TRUE",)], "a string")
    assert cols["a"]["type"] == "boolean"


def test_yes_no_mixed_words(spark):
    cols = _types(spark, [("yes",), ("No",), ("t",)], "a string")
    assert cols["a"]["type"] == "boolean"
    cols = _types(spark, [("yes",), ("No",), ("t",), ("f",)], "a string")
    assert cols["a"]["type"] != "boolean"


def test_l10_boolean_and_inf(spark):
    cols = _types(spark, [(True, 1.0), (False, float("inf")), (None, 2.0)], "b boolean, x double")
    assert cols["b"]["type"] == "boolean"
    assert cols["x"]["type"] == "unknown"
    assert cols["x"]["nulls"] == 0 and cols["x"]["unique"] == 3


def test_counts_and_ranges(spark):
    cols = _types(spark, [(1, 1.5), (2, None), (None, 2.0), (2, 2.0)], "a long, b double")
    a, b = cols["a"], cols["b"]
    assert (a["type"], a["nulls"], a["unique"], a["range_min"], a["range_max"]) == ("integer", 1, 2, 1.0, 2.0)
    assert math.isclose(a["null_pct"], 25.0)
    assert (b["type"], b["cardinality"]) == ("float", "low")
    assert a["nulls"] + 3 == 4


def test_whole_doubles_are_integer(spark):
    cols = _types(spark, [(1.0,), (3.0,)], "q double")
    assert cols["q"]["type"] == "integer"


def test_empty_column_and_table(spark):
    cols = _types(spark, [(None, 1), (None, 2)], "e string, k int")
    assert cols["e"]["type"] == "empty" and cols["e"]["unique"] == 0
    empty = profile(spark.createDataFrame([], "a int"))
    assert empty.rows == 0 and empty.df.schema == PROFILE_SCHEMA and empty.df.count() == 0


def test_top3_and_cardinality(spark):
    rows = [(v,) for v in ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["d"] * 1 + [None] * 2] * 3
    cols = _types(spark, rows, "v string")
    assert cols["v"]["top_values"] == ["a", "b", "c"]
    assert cols["v"]["unique"] == 4 and cols["v"]["cardinality"] == "low"


def test_top3_exact_across_slices(spark):
    # many values, so the salted first step matters: the global top must survive it
    df = spark.range(5000).select((F.col("id") % 997).cast("string").alias("v"))
    df = df.union(spark.createDataFrame([("hot",)] * 40 + [("warm",)] * 30, "v string"))
    p = profile(df.union(df))
    c = p.columns[0]
    assert c["unique"] == 999
    assert c["type"] == "categorical"
    assert c["top_values"][:2] == ["hot", "warm"]


def test_approx_profile_close(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    exact = {c["name"]: c for c in profile(ev).columns}
    approx = {c["name"]: c for c in profile(ev, approx=True).columns}
    for k in exact:
        assert exact[k]["type"] == approx[k]["type"]
        assert abs(exact[k]["unique"] - approx[k]["unique"]) <= max(3, 0.1 * exact[k]["unique"])


def test_sample_rows_and_summary(spark):
    import datetime as dt
    df = spark.createDataFrame([(2, None, dt.datetime(2024, 1, 1, 5)), (1, "x", None), (3, "y", None)],
                               "k long, s string, t timestamp_ntz")
    rows = [r.asDict() for r in sample_rows(df, ["k"]).collect()]
    assert rows[0] == {"k": "1", "s": "x", "t": None}
    assert rows[1] == {"k": "2", "s": "", "t": "2024-01-01 05:00:00"}
    p = profile(df)
    s = summary(df, p, {"m": 1}, ["k"])
    assert s["shape"] == {"rows": 3, "columns": 3} and len(s["sample_rows"]) == 3

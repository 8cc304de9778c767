"""Dates by shape: every accepted form against the general parser and against datetime."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import dates
from quarry.functions.parse import parse_datetime
from quarry.operators.clean import promote_types

FORMS = [
    "2024-01-05", "2024-01-05T10:00:00Z", "2024-01-05 10:00:00+02:00", "2024-01-05 1:02", "2024-01-05 10:00:00.1234567 -0130", "2024-01-05x10:00",
    "2024-01-05 10:00:00 Y", "2024/1/5", "2024/01/05 5:06 pm", "05-01-2024", "1/5/2024", "13/02/2024", "1/5/24", "1/5/71", "1-5/2024",
    "1/5/2024 8:26 AM", "1/5/2024 12:26:30 pm", "1/5/2024 12:26AM", "1/5/2024 13:26 PM", "1/5/2024 10:11 XM", "1/5/2024 24:00", "1/5/2024 10:61",
    "Jan 5, 2024", "Sept. 5 2024", "September 05, 2024 10:11:12.5", "Foo 5, 2024", "5 January 2024", "5-Mar-2024", "31 June 2024", "29 feb 2023",
    "2024-02-30", "2024-13-01", "0/5/2024", "5/2024", "2024", "May", "", "  2024-01-05  ", "12345678", "-12345678", "a b c d e f", None,
]


def both(spark, texts, dayfirst=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    formats = dates.column_formats(df, ["t"], dayfirst)
    got = dates.with_dates(df, formats).orderBy("i").collect()
    old = df.select("i", parse_datetime(F.col("t"), formats["t"].dayfirst).alias("t")).orderBy("i").collect()
    return [r.t for r in got], [r.t for r in old], formats["t"]


@pytest.mark.parametrize("dayfirst", [False, True])
def test_every_form_as_the_general_parser(spark, dayfirst):
    got, old, _ = both(spark, FORMS, dayfirst)
    for text, g, o in zip(FORMS, got, old):
        assert g == o, text


def test_known_values(spark):
    got, _, f = both(spark, ["12/1/2010 8:26", "Sept 5, 2024 1:02:03.5 PM", "2024-01-05T10:00:00.123456789Z", "3/4/69", "3/4/68"])
    assert got == [dt.datetime(2010, 12, 1, 8, 26), dt.datetime(2024, 9, 5, 13, 2, 3, 500000), dt.datetime(2024, 1, 5, 10, 0, 0, 123456), dt.datetime(1969, 3, 4), dt.datetime(2068, 3, 4)]
    assert f.shaped == f.valid == 5


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.datetimes(dt.datetime(1970, 1, 1), dt.datetime(2068, 12, 31)), st.sampled_from(["%d/%m/%Y", "%d-%m-%Y %H:%M", "%d/%m/%y %I:%M:%S %p"])), min_size=1, max_size=40))
def test_the_order_is_that_of_most_valid_dates(spark, rows):
    texts = [t.strftime(f) for t, f in rows]
    got, _, f = both(spark, texts)
    month = sum(t.day <= 12 for t, _ in rows)
    assert f.dayfirst == (month < len(rows))
    if f.dayfirst:
        cut = {"%d/%m/%Y": 0, "%d-%m-%Y %H:%M": 2, "%d/%m/%y %I:%M:%S %p": 3}
        want = [t.replace(microsecond=0, second=t.second if cut[k] > 2 else 0, minute=t.minute if cut[k] else 0, hour=t.hour if cut[k] else 0) for t, k in rows]
        assert got == want


def test_columns_decide_apart_and_ties_are_month_first(spark):
    df = spark.createDataFrame([("13/02/2024", "02/13/2024", "1/2/2024", "13/02/2024"), ("01/02/2024", "02/01/2024", "3/4/2024", "02/13/2024")], "d string, m string, tie string, mixed string")
    out, plan = promote_types(df)
    assert plan == {"d": "timestamp_ntz", "m": "timestamp_ntz", "tie": "timestamp_ntz", "mixed": "string"}
    assert [tuple(r) for r in out.orderBy("m").collect()] == [
        (dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 4), "02/13/2024"),
        (dt.datetime(2024, 2, 13), dt.datetime(2024, 2, 13), dt.datetime(2024, 1, 2), "13/02/2024")]
    assert promote_types(df, dayfirst=False)[1]["d"] == "string" and promote_types(df, dayfirst=True)[1]["m"] == "string"


def test_more_shapes_than_are_compiled(spark, monkeypatch):
    monkeypatch.setattr(dates, "MOST_SHAPES", 3)
    got, old, f = both(spark, FORMS)
    assert f.layouts is None and got == old


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    assert promote_types(df)[1] == {"a": "string", "b": "string"}
    assert promote_types(df.limit(0))[1] == {"a": "string", "b": "string"}
    assert dates.column_formats(df, []) == {}

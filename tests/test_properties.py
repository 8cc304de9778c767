"""Property tests: the hand-written pieces against independent implementations."""

import csv
import io

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import quantiles as Q
from quarry.sources.delimited import field_count

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

field = st.text(alphabet=st.sampled_from(list('ab ,;"|x1')), max_size=6)
rows = st.lists(st.lists(field, min_size=1, max_size=6), min_size=1, max_size=20)


@SETTINGS
@given(rows=rows, sep=st.sampled_from([",", ";", "|"]))
def test_field_count_matches_csv_module(spark, rows, sep):
    lines = []
    for r in rows:
        buf = io.StringIO()
        csv.writer(buf, delimiter=sep, quotechar='"', lineterminator="").writerow(r)
        lines.append(buf.getvalue())
    want = [len(next(csv.reader([ln], delimiter=sep, quotechar='"'))) if ln else 1 for ln in lines]
    df = spark.createDataFrame([(i, ln) for i, ln in enumerate(lines)], "i int, value string")
    got = [r["n"] for r in df.select("i", field_count(F.col("value"), sep).alias("n")).orderBy("i").collect()]
    assert got == want


values = st.lists(st.one_of(st.integers(-50, 50).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)), min_size=1, max_size=60)


@SETTINGS
@given(vals=values, p=st.sampled_from([0.0, 0.01, 0.25, 0.5, 0.99, 1.0]))
def test_exact_quantiles_match_numpy(spark, monkeypatch_module, vals, p):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    ref = float(np.quantile(np.array(vals), p))
    got = Q.exact_quantiles(df, "x", [p])[0]
    assert np.isclose(got, ref, rtol=1e-12, atol=1e-9)
    monkeypatch_module.setattr(Q, "GATHER", 3)  # force the range-refinement path
    try:
        got2 = Q.exact_quantiles(df, "x", [p])[0]
    finally:
        monkeypatch_module.undo()
    assert np.isclose(got2, ref, rtol=1e-12, atol=1e-9)


cells = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(-3, 3)),
              st.one_of(st.none(), st.floats(-5, 5, allow_nan=False).map(lambda x: round(x, 1))),
              st.one_of(st.none(), st.sampled_from(["a", "b", "c", "dd", "e e"]))),
    min_size=1, max_size=40)


@SETTINGS
@given(rows=cells)
def test_profile_counts_match_pandas(spark, rows):
    import pandas as pd

    from quarry.operators.profile import profile

    pdf = pd.DataFrame(rows, columns=["i", "f", "s"]).astype({"i": "Int64", "f": "Float64", "s": "object"})
    df = spark.createDataFrame(rows, "i long, f double, s string")
    got = {c["name"]: c for c in profile(df).columns}
    for name in ["i", "f", "s"]:
        col = pdf[name]
        assert got[name]["nulls"] == int(col.isna().sum())
        assert got[name]["unique"] == int(col.nunique())
        if name != "s" and col.notna().any() and got[name]["type"] in ("integer", "float"):
            assert got[name]["range_min"] == float(col.min()) and got[name]["range_max"] == float(col.max())
    if got["s"]["type"] == "categorical":
        counts = pdf["s"].value_counts()
        want = [v for v, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:3]]
        assert got["s"]["top_values"] == want

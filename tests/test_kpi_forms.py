"""KPI formulas against pandas itself, evaluated over the same rows."""

import numpy as np
import pandas as pd
import pytest

from quarry.functions.formula import FormulaError, compile_formula
from quarry.operators import ordered
from quarry.operators.kpi import grouped_kpi, kpi_value, kpis

N = 240


def frame():
    rng = np.random.default_rng(8)
    t = pd.Timestamp("2023-11-20") + pd.to_timedelta(np.sort(rng.integers(0, 200 * 86400, N)), unit="s")
    return pd.DataFrame({
        "i": np.arange(N), "k": rng.choice(["a", "b", "c", "dd"], N), "m": rng.choice(["x", "y", None], N), "v": np.round(rng.normal(5, 3, N), 2),
        "w": np.where(rng.random(N) < 0.1, np.nan, np.round(rng.normal(size=N), 3)), "n": rng.integers(0, 9, N), "t": t, "u": t + pd.to_timedelta(rng.integers(0, 10**6, N), unit="s"),
        "s": rng.choice(["red apple", "Green", "blue sky", "redder", None], N), "d": [f"{x.month}/{x.day}/{x.year}" for x in t],
    })


@pytest.fixture(scope="module")
def both(spark):
    pdf = frame()
    rows = [tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if isinstance(x, np.generic) else x for x in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "i long, k string, m string, v double, w double, n int, t timestamp_ntz, u timestamp_ntz, s string, d string")
    return pdf, df.repartition(7).cache()


SCALARS = [
    # ordered
    "df['v'].cumsum().max()", "df['w'].cumsum().min()", "df['w'].cummax().mean()", "df['v'].cummin().sum()", "df['v'].diff().mean()", "df['v'].diff(3).max()", "df['n'].shift(2).sum()",
    "df['v'].rolling(7).mean().max()", "df['w'].rolling(4).sum().min()", "df[df['k'] == 'a']['v'].rolling(3).max().mean()", "df['v'].rolling(500).mean().max()",
    # rows and keys by size
    "df.loc[df['v'].idxmax(), 'k']", "df.loc[df['w'].idxmin(), 'i']", "df['v'].nlargest(4).sum()", "df['w'].nsmallest(6).mean()", "df['v'].nlargest().min()", "df['k'].mode()[0]", "df['n'].mode().iloc[0]",
    "df['k'].value_counts().idxmax()", "df['k'].value_counts().index[0]", "df['k'].value_counts().iloc[0]", "df.groupby('k')['v'].sum().idxmax()", "df.groupby('k')['v'].mean().idxmin()", "df.groupby('m').size().max()",
    # typed
    "df['t'].dt.month.nunique()", "df['t'].dt.dayofweek.sum()", "(df['t'].dt.year == 2024).sum()", "(df['t'].max() - df['t'].min()).days", "(df['t'].max() - df['t'].min()).total_seconds()",
    "(df['u'] - df['t']).dt.days.mean()", "(df['u'] - df['t']).dt.total_seconds().max()", "df['s'].str.contains('red', na=False).sum()", "df['s'].str.contains('RED', case=False, na=False).sum()",
    "len(df[df['s'].str.startswith('red', na=False)])", "df['s'].str.len().mean()", "df['v'].astype(int).sum()", "(df['n'] > 3).astype(int).mean()", "pd.to_datetime(df['d']).dt.month.max()",
    "np.where(df['v'] > 5, df['v'], 0).sum()", "pd.to_numeric(df['n']).sum()", "df['k'].str.upper().nunique()", "np.where(df['n'] > 4, 1, 0).mean()",
    # first occurrence
    "df['k'].duplicated().sum()", "df['m'].duplicated().sum()", "df.duplicated().sum()", "df.duplicated(subset=['k', 'n']).sum()", "len(df.drop_duplicates())", "len(df.drop_duplicates(['k', 'm']))",
    "df.drop_duplicates(['k'])['v'].sum()", "df.drop_duplicates(subset='n')['w'].mean()", "len(df) - df.duplicated().sum()",
    # moments and ranks
    "df['v'].corr(df['w'])", "df['v'].cov(df['n'])", "df['w'].skew()", "df['v'].kurt()", "df['n'].prod()", "(df['v'] / 5).prod()", "df['v'].sem()", "np.percentile(df['v'], 90)", "np.quantile(df['v'], 0.25)", "df['w'].quantile(0.1)",
]
GROUPS = [
    "df.groupby(['k', 'n'])['v'].sum()", "df.groupby(['k', 'm']).size()", "df.groupby(df['t'].dt.month)['v'].mean()", "df.groupby('k')['v'].agg('max')", "df.groupby('k').agg({'w': 'count'})",
    "df.groupby(df['s'].str.len())['v'].sum()", "df.resample('ME', on='t')['v'].sum()", "df.resample('W', on='t').size()", "df.resample('QE', on='t')['w'].mean()", "df[df['i'] % 50 == 0].resample('D', on='t')['v'].count()",
    "df[df['n'] == 3].resample('D', on='t')['v'].mean()", "df.resample('YE', on='t')['v'].max()", "df[df['n'] == 2].resample('h', on='t')['v'].sum()",
]


@pytest.mark.parametrize("block", [5, ordered.BLOCK])
def test_scalar_forms(both, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    pdf, df = both
    forms = SCALARS if block > 5 else SCALARS[:11]
    rows = {r["formula"]: r for r in kpis(df, [{"name": f, "formula": f, "importance": 0} for f in forms], order_by=["i"])[0].collect()}
    wrong = {}
    for f in forms:
        want = eval(f, {"df": pdf, "pd": pd, "np": np, "len": len})  # noqa: S307 - the test's own list
        r = rows[f]
        if isinstance(want, str):
            same = r["formatted"] == want and r["value"] is None
        else:
            same = r["value"] is None if pd.isna(want) else r["value"] == pytest.approx(float(want), rel=1e-9, abs=1e-9)
        if r["status"] != "ok" or not same:
            wrong[f] = (r["status"], r["value"], r["formatted"], want)
    assert not wrong


def label(key):
    if isinstance(key, tuple):
        return ", ".join(map(str, key))
    return key


@pytest.mark.parametrize("form", [f for f in GROUPS if "%" not in f])
def test_grouped_forms(both, form):
    pdf, df = both
    want = eval(form, {"df": pdf, "pd": pd, "np": np})  # noqa: S307
    if isinstance(want, pd.DataFrame):
        want = want.iloc[:, 0]
    got = {r["key"]: r["value"] for r in grouped_kpi(df, form).collect()}
    hourly = "'h'" in form
    keys = [k.strftime("%Y-%m-%d %H:%M:%S" if hourly else "%Y-%m-%d") if isinstance(k, pd.Timestamp) else str(int(k)) if isinstance(k, float) else str(label(k)) for k in want.index]
    assert sorted(got) == sorted(keys)
    for k, v in zip(keys, want):
        assert (got[k] is None) if pd.isna(v) else got[k] == pytest.approx(float(v), rel=1e-9), (form, k)


def test_order_is_needed_for_ordered_forms(both):
    _, df = both
    scal, _ = kpis(df, [{"name": "c", "formula": "df['v'].cumsum().max()"}])
    assert scal.first()["status"] == "unsupported"
    with pytest.raises(FormulaError):
        kpi_value(df, "df['v'].cumsum().max()")
    assert kpi_value(df, "df.loc[df['v'].idxmin(), 't']", ["i"]) is not None


def test_ties_go_by_value_and_empty_tables(spark):
    df = spark.createDataFrame([("b", 1.0, 2), ("a", 1.0, 1), ("c", 0.0, 3)], "k string, v double, i int")
    assert kpi_value(df, "df.loc[df['v'].idxmax(), 'k']") == "a" and kpi_value(df, "df['k'].mode()[0]") == "a"
    assert kpi_value(df, "df.groupby('k')['v'].sum().idxmax()") == "a" and kpi_value(df, "df.drop_duplicates(['v'])['i'].sum()") == 4
    none = df.limit(0)
    for f, want in (("df['v'].cumsum().max()", None), ("df['k'].mode()[0]", None), ("df['v'].nlargest(3).sum()", 0), ("df['k'].duplicated().sum()", 0), ("df['v'].skew()", None), ("df['v'].prod()", 1)):
        assert kpi_value(none, f, ["i"]) == want, f
    assert grouped_kpi(none.selectExpr("k", "v", "timestamp_ntz'2024-01-01' as t"), "df.resample('D', on='t')['v'].sum()").count() == 0


def test_what_is_still_refused(both):
    _, df = both
    for f in ("df['v'].apply(abs)", "df['k'].dt.month", "df['s'].str.replace('a', 'b').nunique()", "df['v'].duplicated()", "df.resample('5min', on='t')['v'].sum()", "df['v'].rolling(3)", "df['t'].max() + 1", "df.merge(df)",
              "df['v'].sum(axis=0)", "__import__('os')", "df['k'].corr(df['v'])", "df.loc[df['k'].idxmax(), 'v']"):
        with pytest.raises(FormulaError):
            compile_formula(f, df.schema)

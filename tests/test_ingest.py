"""Ingest ledger: delimiters, encodings, row shapes, NA tokens, names, dates, numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import write_text
from quarry.functions.names import normalize_names, resolve_column
from quarry.functions.parse import parse_datetime
from quarry.functions.tokens import NA_TOKENS
from quarry.operators.clean import promote_types
from quarry.sources.delimited import read_delimited, sniff_delimiter


def test_l1_semicolon_file(spark, tmp_path):
    p = write_text(tmp_path / "a.csv", b"a;b;c\n1;2;3\n4;5;6\n")
    assert sniff_delimiter(["a;b;c", "1;2;3", "4;5;6"]) == ";"
    ing = read_delimited(spark, p)
    assert ing.metadata["delimiter"] == ";"
    assert ing.df.columns == ["a", "b", "c"]
    assert ing.df.count() == 2


def test_sniff_defaults_to_comma():
    assert sniff_delimiter(["abc", "de"]) == ","
    assert sniff_delimiter(["a\tb|c", "1\t2|3"]) == "\t"  # ties keep the earlier candidate


def test_l2_latin1_bytes_restored(spark, tmp_path):
    p = write_text(tmp_path / "l.csv", b"name,n\ncaf\xe9,1\nplain,2\n")
    rows = read_delimited(spark, p).df.orderBy("n").collect()
    assert [r["name"] for r in rows] == ["café", "plain"]


def test_utf8_untouched(spark, tmp_path):
    p = write_text(tmp_path / "u.csv", "name,n\nnaïve €,1\n".encode())
    assert read_delimited(spark, p).df.first()["name"] == "naïve €"


def test_l4_short_long_rows(spark, tmp_path):
    lines = ["a,b,c", "1,2,3", "4,5", "6,7,8,9", "", ",,", "10,11,12,", "1,2,3,,5", '"x,y",2,3', '"p,q",2']
    p = write_text(tmp_path / "s.csv", ("\n".join(lines) + "\n").encode())
    ing = read_delimited(spark, p, promote=False)
    raw = [tuple(r) for r in ing.raw.collect()]
    assert raw == [("1", "2", "3"), ("4", "5", None), (None, None, None), ("x,y", "2", "3"), ("p,q", "2", None)]
    # the all-empty row goes in P4
    assert ing.df.count() == 4
    assert ing.df.select("a").count() == 4
    assert sorted(r["a"] for r in ing.df.select("a").collect()) == ["1", "4", "p,q", "x,y"]
    rej = sorted((r["line"], r["found"]) for r in ing.rejects.collect())
    assert rej == [("1,2,3,,5", 5), ("10,11,12,", 4), ("6,7,8,9", 4)]


def test_strict_rejects_short_rows(spark, tmp_path):
    p = write_text(tmp_path / "st.csv", b"a,b\n1,2\n3\n")
    ing = read_delimited(spark, p, strict=True)
    assert ing.df.count() == 1
    assert ing.rejects.count() == 1


def test_l5_na_tokens(spark, tmp_path):
    body = "\n".join(f"{i},{t}" for i, t in enumerate(NA_TOKENS) if t)
    p = write_text(tmp_path / "na.csv", ("k,v\n" + body + "\n9,keep\n").encode())
    df = read_delimited(spark, p).df
    vals = {r["k"]: r["v"] for r in df.collect()}
    assert vals.pop(9) == "keep"
    assert all(v is None for v in vals.values())


def test_l6_name_collision():
    with pytest.raises(ValueError, match="Unit Price"):
        normalize_names(["Unit Price", "unitprice"])
    assert normalize_names([" N. Name ", "Qty"])[0] == ["nname", "qty"]


def test_l7_dates(spark):
    vals = ["2024-02-03", "01/02/2024", "12/1/2010 8:26", "13/02/2024", "2024-02-30", "2024", "May"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["t"] for r in df.select(parse_datetime(F.col("v")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 2, 3), dt.datetime(2024, 1, 2), dt.datetime(2010, 12, 1, 8, 26),
                   None, None, None, None]
    got_df = [r["t"] for r in df.select(parse_datetime(F.col("v"), dayfirst=True).alias("t")).collect()]
    assert got_df[3] == dt.datetime(2024, 2, 13)


def test_l9_numbers(spark):
    df = spark.createDataFrame(
        [("1,000", "$12.50", "71053", "5d"), (None, None, "85123A", "7"), ("$2", None, "a,b", "8"), ("7%", None, "1", "9")],
        "a string, b string, c string, d string")
    out, plan = promote_types(df)
    assert plan == {"a": "long", "b": "double", "c": "string", "d": "string"}
    rows = out.collect()
    assert [r["a"] for r in rows] == [1000, None, 2, 7]
    assert rows[0]["b"] == 12.5
    assert [r["c"] for r in rows] == ["71053", "85123A", "a,b", "1"]
    assert rows[0]["d"] == "5d"


def test_booleans_and_dates_promoted(spark):
    df = spark.createDataFrame([("True", "2024-01-02"), ("false", None)], "a string, b string")
    out, plan = promote_types(df)
    assert plan == {"a": "boolean", "b": "timestamp_ntz"}
    assert [r["a"] for r in out.collect()] == [True, False]


def test_p13_resolution():
    cols = ["order_id", "unit_price", "qty", "amount_usd"]
    assert resolve_column("ORDER_ID", cols) == "order_id"
    assert resolve_column("price", cols) == "unit_price"
    assert resolve_column("quantity", cols) == "qty"
    assert resolve_column("revenue", cols) == "amount_usd"
    assert resolve_column("zzz", cols) is None


def test_missing_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_delimited(spark, str(tmp_path / "nope.csv"))


def test_utf16_with_bom(spark, tmp_path):
    p = write_text(tmp_path / "w.csv", "a,b\r\n1,élan\r\n2,x\r\n".encode("utf-16"))
    ing = read_delimited(spark, p, encoding="utf-16")
    assert sorted(tuple(r) for r in ing.df.collect()) == [(1, "élan"), (2, "x")]
    assert ing.metadata["encoding_used"] == "utf-16"


def test_metadata_counts(spark, tmp_path):
    p = write_text(tmp_path / "m.csv", b"a,b\n1,2\n,\n3,4,5\n")
    meta = read_delimited(spark, p).with_counts()
    assert meta["original_shape"] == [2, 2] and meta["processed_shape"] == [1, 2]
    assert meta["errors_found"] == 1 and meta["file_size_mb"] > 0
    assert meta["encoding_used"] == "utf-8" and meta["column_mapping"] == {"a": "a", "b": "b"}


def test_first_file_empty(spark, tmp_path):
    write_text(tmp_path / "d" / "a-empty.csv", b"")
    write_text(tmp_path / "d" / "b.csv", b"x,y\n1,2\n")
    write_text(tmp_path / "d" / "c.csv", b"x,y\n3,4\n")
    df = read_delimited(spark, str(tmp_path / "d")).df
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2), (3, 4)]


def test_dates_ignore_session_zone(spark):
    df = spark.createDataFrame([("3/10/2024 2:30",), ("2024-03-10 02:30:00",)], "v string")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:30 is in the DST gap
    try:
        got = [r["t"] for r in df.select(parse_datetime(F.col("v")).alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2024, 3, 10, 2, 30)] * 2


def test_byte_order_marks(spark, tmp_path):
    p8 = write_text(tmp_path / "b8.csv", "\ufeffName,n\ncafé,1\n".encode("utf-8"))
    ing = read_delimited(spark, p8)
    assert ing.df.columns == ["name", "n"] and ing.df.count() == 1
    p16 = write_text(tmp_path / "b16.csv", "Name;n\r\nx;1\r\ny;2\r\n".encode("utf-16"))
    ing16 = read_delimited(spark, p16)  # encoding left on auto
    assert ing16.metadata["encoding_used"] == "utf-16" and ing16.metadata["delimiter"] == ";"
    assert sorted(tuple(r) for r in ing16.df.collect()) == [("x", 1), ("y", 2)]


def test_load_contract(spark, tmp_path):
    from quarry.session import scratch_dir
    from quarry.sources.delimited import load_delimited
    ok, msg, res = load_delimited(spark, str(tmp_path / "missing.csv"))
    assert not ok and "missing.csv" in msg and res is None
    p = write_text(tmp_path / "ok.csv", b"a,b\n1,2\n3,4\n")
    out = scratch_dir(spark, "test-load")
    ok, msg, res = load_delimited(spark, p, save_to=out)
    assert ok and msg.startswith("2 rows in 2 columns")
    assert spark.read.parquet(f"{out}/clean").count() == 2


def test_header_goes_by_position_in_every_file(spark, tmp_path):
    write_text(tmp_path / "h" / "1.csv", b"\n a,b\n1,2\n a,b\n")
    write_text(tmp_path / "h" / "2.csv", b'" a","b"\n3,4\n')
    write_text(tmp_path / "h" / "3.csv", b"")
    rows = sorted(tuple(r) for r in read_delimited(spark, str(tmp_path / "h"), promote=False).df.collect())
    assert rows == [(" a", "b"), ("1", "2"), ("3", "4")]


def test_encoding_is_decided_line_by_line(spark, tmp_path):
    body = b"n,t\n" + b"".join(b"%d,ok\n" % i for i in range(30)) + b"99,caf\xe9\n100,na\xc3\xafve\n"
    p = write_text(tmp_path / "e.csv", body)
    ing = read_delimited(spark, p)
    got = {r["n"]: r["t"] for r in ing.df.collect()}
    assert got[99] == "café" and got[100] == "naïve" and ing.with_counts()["encoding_used"] == "utf-8, else iso-8859-1"


def test_quotes_count_as_the_parser_takes_them(spark, tmp_path):
    lines = ["a,b", '5" x,6" y', '"p ""q"", r",s', '5" x,6" y,LOST', '1,"open', '"x"y,z', "  pad  ,t"]
    p = write_text(tmp_path / "q.csv", ("\n".join(lines) + "\n").encode())
    ing = read_delimited(spark, p, promote=False, strict=True)
    assert sorted(tuple(r) for r in ing.df.collect()) == sorted([('5" x', '6" y'), ('p "q", r', "s"), ("  pad  ", "t")])
    rej = {r["line"]: (r["found"], r["line_number"]) for r in ing.rejects.collect()}
    # the quote that opens in line 5 closes in line 6: two lines of one record
    assert rej == {'5" x,6" y,LOST': (3, 4), '1,"open': (None, 5), '"x"y,z': (None, 6)}
    assert all(r["file"].endswith("q.csv") for r in ing.rejects.collect())


def test_long_quoted_field_needs_no_deep_recursion(spark, tmp_path):
    p = write_text(tmp_path / "l.csv", b'a,b\n"' + b'x""' * 60000 + b'",1\n')
    assert read_delimited(spark, p).df.count() == 1


def test_line_breaks_in_quotes(spark, tmp_path):
    p = write_text(tmp_path / "m.csv", b'a,b\n1,"x\ny"\n2,z\n3,"p, ""q""\n\n r"\n4\n5,6,7\n')
    one = read_delimited(spark, p, multiline=True, promote=False)
    assert sorted(tuple(r) for r in one.df.collect()) == [("1", "x\ny"), ("2", "z"), ("3", 'p, "q"\n\n r'), ("4", None)]
    assert [r["found"] for r in one.rejects.collect()] == [3]
    by_line = read_delimited(spark, p, promote=False)
    assert ("1", "x") not in {tuple(r) for r in by_line.df.collect()}
    assert '1,"x' in {r["line"] for r in by_line.rejects.collect()}


def test_wide_whole_numbers_keep_their_digits(spark):
    rows = [("1234567890123456789", "12345678901234567890123", "1.5", "1" * 45), ("1234567890123456788", "7", "12345678901234567890123", "2")]
    df, plan = promote_types(spark.createDataFrame(rows, "a string, b string, c string, d string"))
    assert plan == {"a": "long", "b": "decimal(38,0)", "c": "string", "d": "string"}
    assert {r["a"] for r in df.collect()} == {1234567890123456789, 1234567890123456788}


@pytest.mark.parametrize("text, want", [
    ("2024-01-05T10:00:00Z", (2024, 1, 5, 10)), ("2024-01-05 10:00:00+02:00", (2024, 1, 5, 10)), ("2024/01/05", (2024, 1, 5)),
    ("05-01-2024", (2024, 5, 1)), ("Jan 5, 2024", (2024, 1, 5)), ("5 January 2024", (2024, 1, 5)), ("1/5/24", (2024, 1, 5)), ("1/5/71", (1971, 1, 5)),
    ("1/5/2024 8:26 AM", (2024, 1, 5, 8, 26)), ("1/5/2024 12:26:30 pm", (2024, 1, 5, 12, 26, 30)), ("1/5/2024 13:26 PM", None),
    ("Foo 5, 2024", None), ("5/2024", None), ("1-5/2024", None), ("2024-13-01", None), ("13/13/2024", None),
])
def test_date_forms(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse_datetime(F.col("t")).alias("d")).first()["d"]
    assert got == (dt.datetime(*want) if want else None)


def test_lenient_dates_count_their_failures(spark):
    df = spark.createDataFrame([(f"2024-01-{i:02d}",) for i in range(1, 20)] + [("unknown",), (None,)], "d string")
    assert promote_types(df)[1] == {"d": "string"}
    failures = {}
    out, plan = promote_types(df, lenient=0.9, failures=failures)
    assert plan == {"d": "timestamp_ntz"} and failures == {"d": 1} and out.where("d is null").count() == 2


def test_number_forms_and_noise_decide_the_same_types(spark):
    """Bare numbers go by one look, the rest through all tests: one value with noise, a wide one or
    one that is no number decides its column as if each were tested in full."""
    rows = [("1", "1", "1.5", "+7", "1", "5", "1e3", "00012", "12"),
            ("1,234", "9223372036854775808", "$2", "-8", "1.5", "5-", ".5", "9" * 19, "12\n"),
            (None, "-3", "3%", None, "9" * 20, "6", "2.", "7", "13")]
    names = list("abcdefghi")
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    out, plan = promote_types(df)
    assert plan == {"a": "long", "b": "decimal(38,0)", "c": "double", "d": "long", "e": "string", "f": "string", "g": "double", "h": "decimal(38,0)", "i": "string"}
    assert {"b", "d", "g", "h"} <= plan.bare and not plan.bare & {"a", "c", "f", "i"}
    got = out.collect()
    assert [r["a"] for r in got] == [1, 1234, None] and [r["c"] for r in got] == [1.5, 2.0, 3.0]
    assert [int(r["b"]) for r in got] == [1, 9223372036854775808, -3] and [r["d"] for r in got] == [7, -8, None]
    assert [r["g"] for r in got] == [1000.0, 0.5, 2.0] and [int(r["h"]) for r in got] == [12, int("9" * 19), 7]


def test_lines_known_to_be_utf8_are_not_decoded_again(spark, tmp_path):
    """The scan for the records has seen every byte: only files with other bytes are decoded line by line."""
    (tmp_path / "a.csv").write_bytes("\ufeffid,name\n1,caf\u00e9\n\n2,\u6f22\u00a0\n".encode())
    ing = read_delimited(spark, str(tmp_path), sep=",")
    assert [tuple(r) for r in ing.df.orderBy("id").collect()] == [(1, "caf\u00e9"), (2, "\u6f22\u00a0")]
    assert "encode(" not in ing.raw._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "b.csv").write_bytes(b"id,name\n3,caf\xe9\n")
    (tmp_path / "a.csv").write_bytes("id,name\n1,caf\u00e9\n".encode())
    ing = read_delimited(spark, str(tmp_path), sep=",")
    assert [tuple(r) for r in ing.df.orderBy("id").collect()] == [(1, "caf\u00e9"), (3, "caf\u00e9")]

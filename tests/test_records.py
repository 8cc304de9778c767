"""Records over splits: quoted line breaks, line numbers, headers by file, against plain Python."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from helpers import write_text
from quarry.functions import dates
from quarry.operators import clean
from quarry.sources import records
from quarry.sources.delimited import read_delimited


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: small_splits(spark, size)
    for k, v in old.items():
        spark.conf.set(k, v)


def random_csv(rng, rows):
    pool = ["a", "b c", 'q"q', "line\nbreak", 'x,"y"\n\n', "", '""', "é", "\n", "z" * 30, "tail\r\n"]
    data = [[str(i), rng.choice(pool) + rng.choice(pool), rng.choice(pool)] for i in range(rows)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["id", "t", "u"])
    w.writerows(data)
    return data, out.getvalue().encode()


@pytest.mark.parametrize("size", [60, 400, 1 << 20])
def test_records_over_splits_as_the_csv_module_reads_them(spark, tmp_path, splits, size):
    rng = random.Random(size)
    want = []
    for f in range(3):
        data, raw = random_csv(rng, 60)
        want += [tuple(v or None for v in r) for r in data]
        write_text(tmp_path / "d" / f"{f}.csv", raw)
    splits(size)
    ing = read_delimited(spark, str(tmp_path / "d"), sep=",", multiline=True, promote=False, na_tokens=[""])
    assert sorted(map(str, map(tuple, ing.df.collect()))) == sorted(map(str, want))
    assert ing.rejects.count() == 0


@pytest.mark.parametrize("size", [25, 1 << 20])
def test_default_mode_keeps_no_fragment_and_numbers_every_line(spark, tmp_path, splits, size):
    text = 'a,b\n1,x\n\n2,"y\nfragment,here\nmore"\n3,z,LONG\n"4"5,w\n6\n"7,8"",9"\n'
    p = write_text(tmp_path / "n.csv", text.encode())
    splits(size)
    ing = read_delimited(spark, p, sep=",", promote=False)
    assert sorted(map(tuple, ing.df.collect()), key=str) == sorted([("1", "x"), ("45", "w"), ("6", None), ('7,8",9', None)], key=str)
    got = sorted((r["line_number"], r["line"], r["expected"], r["found"]) for r in ing.rejects.collect())
    assert got == [(4, '2,"y', 2, None), (5, "fragment,here", 2, None), (6, 'more"', 2, None), (7, "3,z,LONG", 2, 3)]
    whole = read_delimited(spark, p, sep=",", promote=False, multiline=True)
    assert ("2", "y\nfragment,here\nmore") in set(map(tuple, whole.df.collect()))
    assert [(r["line_number"], r["found"]) for r in whole.rejects.collect()] == [(7, 3)]


@pytest.mark.parametrize("size", [30, 1 << 20])
def test_a_quote_that_never_closes(spark, tmp_path, splits, size):
    p = write_text(tmp_path / "o.csv", b'a,b\n1,x\n2,"open\n3,y\n4,z\n')
    q = write_text(tmp_path / "p.csv", b"a,b\n5,v\n")
    splits(size)
    for multiline in (False, True):
        ing = read_delimited(spark, [p, q], sep=",", promote=False, multiline=multiline)
        assert sorted(map(tuple, ing.df.collect())) == [("1", "x"), ("5", "v")]
        assert sorted((r["line_number"], r["line"]) for r in ing.rejects.collect()) == [(3, '2,"open'), (4, "3,y"), (5, "4,z")]


def test_a_record_beyond_the_bound(spark, tmp_path, splits, monkeypatch):
    monkeypatch.setattr(records, "MOST_RECORD_BYTES", 40)
    p = write_text(tmp_path / "l.csv", b'a,b\n1,"x\ny"\n2,"' + b"long\n" * 30 + b'"\n3,z\n')
    for size in (35, 1 << 20):
        splits(size)
        ing = read_delimited(spark, p, sep=",", promote=False, multiline=True)
        assert sorted(map(tuple, ing.df.collect())) == [("1", "x\ny"), ("3", "z")]
        assert sorted(r["line_number"] for r in ing.rejects.collect()) == list(range(4, 35))


def test_columns_by_each_files_header(spark, tmp_path):
    write_text(tmp_path / "h" / "1.csv", b"id,name\n1,x\n2,y,LONG\n")
    write_text(tmp_path / "h" / "2.csv", b"\nName, ID ,extra\nz,3,e\nw,4\n")
    write_text(tmp_path / "h" / "3.csv", b"extra\nonly\na,b\n")
    ing = read_delimited(spark, str(tmp_path / "h"), sep=",", promote=False)
    assert ing.df.columns == ["id", "name", "extra"]
    assert sorted(map(tuple, ing.df.collect()), key=str) == sorted([("1", "x", None), ("3", "z", "e"), ("4", "w", None), (None, None, "only")], key=str)
    assert sorted((r["file"][-5:], r["line_number"], r["expected"], r["found"]) for r in ing.rejects.collect()) == [("1.csv", 3, 2, 3), ("3.csv", 3, 1, 2)]


def test_latin1_and_utf16_files_among_others_with_line_breaks(spark, tmp_path):
    write_text(tmp_path / "e" / "1.csv", b'a,b\n1,"caf\xe9\nx"\n')
    write_text(tmp_path / "e" / "2.csv", "a,b\r\n2,\"naïve\r\ny\"\r\n".encode())
    write_text(tmp_path / "e" / "3.csv", 'b,a\r\n"élan\nz",3\r\n'.encode("utf-16"))
    ing = read_delimited(spark, str(tmp_path / "e"), sep=",", promote=False, multiline=True)
    assert sorted(map(tuple, ing.df.collect())) == [("1", "café\nx"), ("2", "naïve\r\ny"), ("3", "élan\nz")]
    assert ing.metadata["encoding_used"] == "utf-8, else iso-8859-1, utf-16"


def test_text_after_a_closing_quote_is_part_of_the_field(spark, tmp_path):
    p = write_text(tmp_path / "c.csv", b'a,b\n1,"a"b\n"x" ,"p ""q"" r"s\n')
    ing = read_delimited(spark, p, sep=",", promote=False)
    assert sorted(map(tuple, ing.df.collect())) == [("1", "ab"), ("x ", 'p "q" rs')]
    assert ing.rejects.count() == 0


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", [20, 1 << 20])
def test_files_of_several_headers_without_line_breaks_need_no_walk(spark, tmp_path, splits, size):
    """Every line is a record: its file says its header, so no line goes through Python for its place."""
    write_text(tmp_path / "h" / "1.csv", b"\n \r\nid,name,d\r\n1,x,2024-01-31\r\n\r\n2,,2024-02-01 10:00:00\r\n3,y,,LONG\r\n")
    write_text(tmp_path / "h" / "2.csv", "d,id,extra,name\n2024-03-01,4,é,\"q,\"\"r\"\n,5\n".encode())
    write_text(tmp_path / "h" / "3.csv", b"\n")
    splits(size)
    ing = read_delimited(spark, str(tmp_path / "h"), sep=",")
    assert "_walk" not in optimized(ing.df) and "_walk" in optimized(ing.rejects)
    assert ing.df.dtypes == [("id", "bigint"), ("name", "string"), ("d", "timestamp_ntz"), ("extra", "string")]
    got = sorted((r["id"], r["name"], str(r["d"]), r["extra"]) for r in ing.df.collect())
    assert got == [(1, "x", "2024-01-31 00:00:00", None), (2, None, "2024-02-01 10:00:00", None), (4, 'q,"r', "2024-03-01 00:00:00", "é"), (5, None, "None", None)]
    assert [(r["file"][-5:], r["line_number"], r["expected"], r["found"]) for r in ing.rejects.collect()] == [("1.csv", 7, 3, 4)]


def test_lines_that_repeat_their_header_are_records(spark, tmp_path):
    write_text(tmp_path / "r" / "1.csv", b"a,b\n1,x\na,b\na,b\n")
    write_text(tmp_path / "r" / "2.csv", b"b,a\ny,2\na,b\n")
    ing = read_delimited(spark, str(tmp_path / "r"), sep=",", promote=False)
    assert sorted(map(tuple, ing.df.collect())) == [("1", "x"), ("2", "y"), ("a", "b"), ("a", "b"), ("b", "a")]


@pytest.mark.parametrize("sep", [",", "|", "\t"])
def test_records_cut_at_separators_are_as_the_parser_has_them(spark, tmp_path, sep):
    texts = ["1,2,3", ",,", "a,", "a", " a , b,\tc ", "a\r", "a\rb,c", "a,b\0c,d", '"",x', 'a"b,c', '"a,b",c', "a\\,b", "é,漢, ", "#c,d", "1,2,3,4", "NA,null,x"]
    lines = [t.replace(",", sep) for t in texts]
    for tokens in (None, [], ["NA"]):
        for i, kept in enumerate((lines, [t for t in lines if '"' not in t and "\0" not in t and "\r" not in t])):
            write_text(tmp_path / f"{i}" / "1.csv", "\n".join([f"a{sep}b{sep}c", *kept, ""]).encode())
            write_text(tmp_path / f"{i}" / "2.csv", "b\nz\n".encode())
            ing = read_delimited(spark, str(tmp_path / f"{i}"), sep=sep, promote=False, na_tokens=tokens)
            rows = [t[:-1] if t.endswith("\r") else t for t in kept]
            opts = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
            wide = spark.createDataFrame([(t,) for t in rows if t.count(sep) < 3], "t string").select("t", F.from_csv("t", "a string, b string, c string", opts).alias("r"))
            none = {"", "NA", "null"} if tokens is None else set(tokens)
            want = [tuple(None if v in none else v for v in r["r"]) for r in wide.collect()] + [(None, "z", None)]
            want = sorted((r for r in want if any(v is not None for v in r)), key=ascii)
            assert sorted(map(tuple, ing.df.collect()), key=ascii) == want


def test_usual_dates_are_counted_with_the_kinds(spark, monkeypatch):
    """Shapes and valid dates of the usual forms come with the evidence, other forms by their own count."""
    good = ["2024-02-29", "2024-01-31 23:59:59", " 1999-12-31 00:00:00.5 ", "2024-01-01 00:00:00.123456789", None]
    cases = {"u": good, "bad": ["2024-02-30", *good[1:]], "late": ["2024-01-01 24:00:00", *good[1:]], "t": ["2024-01-01T10:00:00", *good[1:]], "dm": ["31/01/2024", *good[1:]], "end": ["2024-01-01\n", *good[1:]]}
    df = spark.createDataFrame(list(zip(*cases.values())), ", ".join(f"{c} string" for c in cases))
    out, plan = clean.promote_types(df)
    assert plan == {"u": "timestamp_ntz", "bad": "string", "late": "string", "t": "timestamp_ntz", "dm": "timestamp_ntz", "end": plan["end"]}
    assert [str(r["u"]) for r in out.select("u").collect()] == ["2024-02-29 00:00:00", "2024-01-31 23:59:59", "1999-12-31 00:00:00.500000", "2024-01-01 00:00:00.123456", "None"]
    for order in (None, True, False):
        whole = dates.column_formats(df, df.columns, order)
        assert {c: plan.formats[c].layouts for c in plan.formats} == {c: whole[c].layouts for c in plan.formats}
        assert (whole["u"].valid, whole["bad"].valid, whole["late"].valid) == (4, 3, 3)
    monkeypatch.setattr(dates, "_with_shapes", None)  # what the count of valid dates scans again
    assert clean.promotion_plan(df.select("u", "bad", "late")) == {"u": "timestamp_ntz", "bad": "string", "late": "string"}

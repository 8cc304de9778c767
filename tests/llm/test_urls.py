"""URL filters and components against plain Python."""

import random

from quarry.llm import urls
from quarry.llm.graph import components


def brute_components(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


def test_components(spark):
    rng = random.Random(2)
    for edges in (
        [], [(1, 1), (None, 2)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 200)],
        [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
    ):
        df = spark.createDataFrame(edges, "a long, b long")
        got = [tuple(r) for r in components(df).collect()]
        assert dict(got) == brute_components(edges) and len(got) == len(dict(got))


ROWS = [
    (1, "https://www.a.net/x.html?utm_source=f", None), (2, "http://a.net/x/", ""), (3, "https://b.example.net/en/1", "p"), (4, "https://example.com/de/2", "p"),
    (5, "http://x.org/fr/3#top", None), (6, "HTTP://Z.ORG", "p"), (7, None, None), (8, "no scheme", "p"), (9, "https://", "p"), (9, "https://", "p"),
    (10, "https://alias.org/a", '<LINK rel="canonical" href="https://example.com/de/2">'), (11, "https://alias.org/b", '<meta http-equiv="refresh" content="0; url=/a">'),
    (12, "https://q.org/1", '<link rel=canonical href="https://b.example.net/en/1">'), (13, "https://q.org/2", "<link rel='canonical' href='https://q.org/1'>"),
    (14, "https://q.org/2?x=1", '<link rel="canonical" href="https://example.com/de/9">'), (None, "ftp://n.net", None), (15, "a://b.net/c://d", "x"),
    (16, "https://m.alias.org/b.html?ref=1", "p"), (17, "https://q.org/1?ref=2", '<link rel="canonical" href="https://example.com/de/8">'),
]


def test_rules_aliases_and_precedence(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as key", "'h' as host", "2 as r")
    rows = urls.filter_urls(df, urls.page_links(df)).collect()
    assert len(rows) == len(ROWS)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[1] == ("www.a.net", "/x.html", "net/", "block") and got[3][2:] == ("example.net/en/", "allow")
    assert got[4][2:] == ("example.com/de/", "block") and got[5] == ("x.org", "/fr/3", "org/fr/", "allow")
    assert got[6] == ("z.org", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow")
    # aliases of a blocked page are blocked, through a redirect as well as a canonical link and a mirror host
    assert got[10][2:] == (None, "block") and got[11][2:] == (None, "block") and got[16][2:] == (None, "block")
    # one allowed member outweighs blocked ones, but not a page's own rule
    assert got[12][2:] == (None, "allow") and got[13][2:] == (None, "allow") and got[17][2:] == (None, "allow")
    assert got[14][2:] == (None, "block")
    assert got[None][:2] == ("n.net", "") and got[15][:2] == ("b.net", "/c://d")


LINKS = [
    ("https://a.org/x/y.html?q=1", "//b.org/z"), ("https://a.org/x/y.html?q=1", "z.html"), ("https://a.org/x/y.html?q=1", "?p=1"), ("https://a.org/x/y.html", "../z"),
    ("https://a.org/x/y.html", "../../../z/./w?a=../b"), ("https://a.org", "z"), ("https://a.org?q", "z"), ("https://a.org/x", "/z/../w#f"), ("https://a.org/x/", "sub/"),
    ("https://a.org/x", "ftp://c.org/1"), ("https://a.org/x", "mailto:x@y.z"), ("https://a.org/x", "#top"), ("no scheme", "z"), ("https://a.org/x/", "z?u=http://q.org/"),
]


def test_relative_links(spark):
    from urllib.parse import urljoin

    df = spark.createDataFrame(LINKS, "page string, target string")
    got = [r.t for r in df.select(urls.resolve(df.page, df.target).alias("t")).collect()]
    none = {"mailto:x@y.z", "#top"}
    assert got == [None if t in none or "://" not in p else urljoin(p, t) for p, t in LINKS]


def test_all_links_of_a_page_and_long_html(spark):
    html = "<link rel=canonical href='/1'><LINK REL=\"canonical\" HREF=\"//c.org/2\"><meta http-equiv=refresh content='0; url=3'><meta http-equiv='refresh' content='1;URL=?4'><link rel=canonical>"
    rows = [(1, "https://a.org/d/e", html), (2, "https://l.org/", "<link " * 40000 + "canonical http-equiv" + "x" * 100000 + "<link rel='canonical' href='z'>"), (3, "https://u.org/" + "y" * 200000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.source, r.target) for r in urls.page_links(df).collect())
    assert got == sorted([("https://a.org/d/e", t) for t in ("https://a.org/1", "https://c.org/2", "https://a.org/d/3", "https://a.org/d/e?4")] + [("https://l.org/", "https://l.org/z")])
    assert urls.filter_urls(df, urls.page_links(df)).count() == 3


def test_sql_twin_follows_the_links(spark, tmp_path):
    import duckdb

    html = [f'<link rel="canonical" href="{t}">' for _, t in LINKS]
    rows = [*ROWS, *((100 + i, p, h) for i, ((p, _), h) in enumerate(zip(LINKS, html)))]
    rows += [(200, "https://a.org/z", "<link rel=canonical href='https://example.com/de/q'>"), (201, "https://b.org/z/", "<meta http-equiv=refresh content='0;url=../fr/x'>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    res = con.sql(urls.ORACLE)
    got = urls.op5_url_filters(spark, str(tmp_path)).select(*res.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, res.fetchall()))


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.filter_urls(df, urls.page_links(df)).count() == 0

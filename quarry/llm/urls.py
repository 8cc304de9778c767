"""URL filters with redirect equivalence.

Rules (host, path, block or allow) decide a url directly. For urls without a rule, the
decision comes from their aliases: urls with the same canonical key (mirror host, file
ending, tracking parameters and fragment aside) are one node, redirect and canonical-link
edges join nodes, and a connected component with an allowed member is allowed, else one with
a blocked member is blocked, else it is allowed. SQL functions only; components run
distributed over the edges, never over pages without one.

Defined results: a null url or one without ``://`` has empty host and path, no rule and no
aliases, and is allowed; repeated rows are judged row by row; all canonical links and
refreshes of a page count, relative ones (``//host/x``, ``/x``, ``x``, ``?x``, ``..``) resolved
against its url, a ``<base>`` tag not read; an empty table gives an empty result; only the id,
url and html columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.graph import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name no other content.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """The canonical key of a url; null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), "/+$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise("")))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as struct<rule, verdict>; null when none fits. Of equally long
    ones an allow rule wins. The rules are a short list carried in the plan."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


_LINK = r"""(?i)<link\b[^<>]*\brel\s*=\s*["']?canonical\b[^<>]*>"""
_META = r"""(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b[^<>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TO = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
_ORIGIN, _SCHEME = "^.*?://[^/?#]*", "^[A-Za-z][A-Za-z0-9+.-]*:"


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments taken out, what follows the path kept."""
    own, rest = F.regexp_extract(path, "^[^?#]*", 0), F.regexp_extract(path, "^[^?#]*(.*)$", 1)
    kept = F.aggregate(
        F.split(own, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.array_join(kept, "/"), rest)


def resolve(page: Column, target: Column) -> Column:
    """The whole url that a link of a page means; null for other schemes than ``x://``, for a
    place in the page itself, and for relative links of a page without an origin."""
    origin, path = F.regexp_extract(page, _ORIGIN, 0), path_of(page)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(target.rlike(_SCHEME + "//"), target)
        .when(target.rlike(_SCHEME) | F.startswith(target, F.lit("#")) | (F.coalesce(origin, F.lit("")) == ""), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(page, "^(.*?)://", 1), F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, _without_dots(target)))
        .when(F.startswith(target, F.lit("?")), F.concat(origin, path, target))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, target))))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(source, target)`` urls of all canonical links and meta redirects that pages declare,
    relative ones resolved against the page's url."""
    html, url = common.col(html_col), common.col(url_col)

    def declared(mark: str, tag: str, attribute: str) -> Column:
        tags = F.regexp_extract_all(html, F.lit(tag), F.lit(0))
        found = F.transform(tags, lambda t: F.regexp_extract(t, attribute, 1))
        return F.coalesce(F.when(F.contains(F.lower(html), F.lit(mark)), found), F.array().cast("array<string>"))

    targets = F.concat(declared("canonical", _LINK, _HREF), declared("http-equiv", _META, _TO))
    links = pages.select(url.alias("source"), F.explode(F.filter(targets, lambda t: t != "")).alias("t"))
    return links.select("source", resolve(F.col("source"), F.col("t")).alias("target")).filter("target is not null")


def filter_urls(pages: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, alias_key, alias_group.

    ``links`` holds (source, target) urls: redirects and canonical links. Decisions are
    aggregated per key before they meet the components, so a key or host that holds a third
    of all pages is one row there.
    """
    url = common.col(url_col)
    judged = lambda df, u: df.select("*", host_of(u).alias("host"), path_of(u).alias("path"), alias_key(u).alias("key")).withColumn(
        "r", rule_of(F.col("host"), F.col("path"), rules)
    )
    rows = judged(pages.select(common.col(id_col).alias("id"), url.alias("u")), F.col("u"))
    ends = links.select(F.explode(F.array("source", "target")).alias("u"))
    seen = rows.select("key", "r").unionByName(judged(ends, F.col("u")).select("key", "r")).filter("key is not null")
    flag = lambda v: F.max(F.coalesce(F.col("r.verdict") == v, F.lit(False))).alias(v)
    by_key = seen.groupBy("key").agg(flag("allow"), flag("block"))
    joined = components(links.select(alias_key(F.col("source")).alias("a"), alias_key(F.col("target")).alias("b")))
    grouped = by_key.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("component", "key"))
    by_group = grouped.groupBy("group").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    by_key = grouped.select("key", "group").join(by_group, "group")
    method = F.when(F.col("block") & ~F.col("allow"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(by_key, "key", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), method).alias("verdict"), F.col("key").alias("alias_key"), F.col("group").alias("alias_group"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules and by its aliases' decisions."""
    pages = common.table(spark, sf_dir, "pages")
    return filter_urls(pages, common.saved(page_links(pages)))


_KEY = r"""CASE WHEN regexp_extract({u}, '://([^/?#]*)', 1) <> '' THEN regexp_replace(translate(regexp_extract({u}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(www|m)\.', '')
  || regexp_replace(regexp_replace(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '(/index)?\.html?$', ''), '/+$', '')
  || CASE WHEN len(list_filter(string_split(regexp_extract({u}, '://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) > 0
     THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&') ELSE '' END END"""

ORACLE = r"""
WITH RECURSIVE rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
t AS (SELECT url, regexp_extract(url, '^.*?://[^/?#]*') AS origin, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^<>]*\brel\s*=\s*["'']?canonical\b[^<>]*>'), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^<>]*>'), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS t FROM pages),
w AS (SELECT *, CASE WHEN t LIKE '/%' THEN t ELSE coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || t END AS p FROM t WHERE t <> ''),
l AS (SELECT url AS s, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR t LIKE '#%' OR coalesce(origin, '') = '' THEN NULL
    WHEN t LIKE '//%' THEN regexp_extract(url, '^(.*?)://', 1) || ':' || t WHEN t LIKE '?%' THEN origin || path || t
    ELSE origin || array_to_string(list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split(regexp_extract(p, '^[^?#]*'), '/'), lambda x: [x])),
      lambda a, b: CASE WHEN b[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[1 : len(a) - 1] ELSE a END WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END), '/')
      || regexp_extract(p, '^[^?#]*(.*)$', 1) END AS d FROM w),
u AS (SELECT true AS page, page_id, url AS u FROM pages UNION ALL SELECT false, NULL, unnest([s, d]) FROM l WHERE d IS NOT NULL),
k AS (SELECT row_number() OVER () AS rid, page, page_id, u, translate(coalesce(regexp_extract(u, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), '') AS path, KEY(u) AS key FROM u),
r AS (SELECT rid, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
    FROM k JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
e AS (SELECT KEY(s) AS a, KEY(d) AS b FROM l WHERE d IS NOT NULL),
sym AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a AS n, a AS m FROM sym UNION SELECT sym.b, reach.m FROM reach JOIN sym ON sym.a = reach.n),
c AS (SELECT n, min(m) AS g FROM reach GROUP BY n),
j AS (SELECT k.*, r.rule, r.v, coalesce(c.g, k.key) AS g FROM k LEFT JOIN r USING (rid) LEFT JOIN c ON c.n = k.key),
f AS (SELECT g, bool_or(coalesce(v = 'allow', false)) AS allow, bool_or(coalesce(v = 'block', false)) AS block FROM j WHERE g IS NOT NULL GROUP BY g)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN f.block AND NOT f.allow THEN 'block' ELSE 'allow' END) AS verdict, key AS alias_key, j.g AS alias_group
FROM j LEFT JOIN f ON f.g = j.g WHERE page
""".replace("KEY(u)", _KEY.format(u="u")).replace("KEY(s)", _KEY.format(u="s")).replace("KEY(d)", _KEY.format(u="d"))

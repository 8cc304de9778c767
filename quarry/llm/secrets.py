"""Secrets in texts, judged by who else holds the same value across the corpus.

Patterns propose candidates (SQL functions only). The SHA-256 of each candidate's value is
aggregated over the corpus by distinct repositories and owners: a value that several owners
or many repositories hold is a widely copied *example*; one that a single owner holds in few
repositories and that looks generated is *live*; the rest is *unclear*. Counting is pre-aggregated in each task by (value, owner,
repository), so a value that stands in a third of all rows costs no task more than its
distinct owners.

Base spans (assign, access, hex) always stay; the method adds the kinds github, slack, jwt
and private_key and the verdict of every span. Defined results: a null or empty text has no
spans; repeated rows are judged row by row and count once as owners; a null owner or
repository counts as one unnamed; an empty table gives an empty result; further columns and
their names do not matter. Whole texts are scanned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.spans import pattern_spans

#: From so many distinct owners on, a value is a copied example.
EXAMPLE_OWNERS = 3
#: So is one in so many distinct repositories, be they of one owner.
EXAMPLE_REPOS = 6
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""


@dataclass(frozen=True)
class Kind:
    """``valid`` checks a match; ``value`` is the secret within it."""

    name: str
    pattern: str
    guard: Callable[[Column], Column]
    value: Callable[[Column], Column] = lambda m: m
    least: int = 0
    base: bool = False


def _holds(part: str) -> Callable[[Column], Column]:
    return lambda t: F.contains(t, F.lit(part))


def _search(pattern: str) -> Callable[[Column], Column]:
    return lambda t: t.rlike(pattern)


KINDS = (
    Kind("assign", _ASSIGN, _search("(?i)(?:passw|secret|token|api_?key)"), lambda m: F.regexp_extract(m, _ASSIGN, 1), 8, base=True),
    Kind("access", "AKIA[A-Z0-9]{12,}+", _holds("AKIA"), base=True),
    Kind("hex", "(?<![0-9a-f])[0-9a-f]{32,}+", _search("[0-9a-f]{32}"), base=True),
    Kind("github", "gh[pousr]_[A-Za-z0-9]{36,}+", _search("gh[pousr]_")),
    Kind("slack", "xox[abprs]-[A-Za-z0-9-]{10,}+", _holds("xox")),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", _holds("eyJ")),
    Kind("private_key", r"-----BEGIN\x20(?:[A-Z]{2,10}\x20)?PRIVATE\x20KEY-----", _holds("PRIVATE KEY")),
)
BASE = tuple(k.name for k in KINDS if k.base)
_LISTED = {k.name: i for i, k in enumerate(KINDS)}
_FAKE = "(?i)example|sample|change.?me|placeholder|dummy|your|xxxx|0000|1234567|abcdef"


def _looks_generated(value: Column) -> Column:
    """Enough distinct characters, letters and digits, and no filler word."""
    chars = F.array_size(F.array_distinct(F.split(value, "")))
    return (chars >= 9) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(_FAKE)


def _kind_spans(text: Column, k: Kind) -> Column:
    found = pattern_spans(text, k.name, k.pattern, k.guard(text))
    if k.least:
        found = F.filter(found, lambda s: F.length(k.value(s["match"])) >= k.least)
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(_LISTED[k.name]).alias("listed"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.sha2(k.value(s["match"]), 256).alias("value_hash"), _looks_generated(k.value(s["match"])).alias("generated"),
    ))


def find_secrets(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with its candidates: array<struct<start, listed, kind, end, value_hash, generated>>
    by start, then kind as listed. The value itself is not kept."""
    text = common.col(text_col)
    cols = {common.free_name(df, f"{k.name}_spans"): _kind_spans(text, k) for k in KINDS}
    return df.withColumns(cols).withColumn(out, F.array_sort(F.concat(*map(common.col, cols)))).drop(*cols)


def ownership(values: DataFrame) -> DataFrame:
    """Per ``value_hash``: n_owners and n_repos, the distinct owners and (owner, repository)
    pairs that hold it. ``values`` has value_hash, owner, repo; nulls count as one unnamed."""
    held = values.select("value_hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    repos = held.groupBy("value_hash", "owner").agg(F.countDistinct("repo").alias("n"))
    return repos.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def verdict(generated: Column, n_owners: Column, n_repos: Column) -> Column:
    return (
        F.when((n_owners >= EXAMPLE_OWNERS) | (n_repos >= EXAMPLE_REPOS), F.lit("example"))
        .when(generated & (n_owners == 1), F.lit("live"))
        .otherwise(F.lit("unclear"))
    )


def judge_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """One row per document: id and ``spans``, array<struct<start, listed, kind, end,
    verdict, n_owners, n_repos>> by start, then kind.

    ``owner`` and ``repo`` say who holds a document (default: no one known, so every value
    has one owner). The scan's findings are checkpointed, so texts are read once.
    """
    none = F.lit(None).cast("string")
    own = common.free_name(docs, "owner_"), common.free_name(docs, "repo_")
    held = docs.select(
        common.col(id_col), common.col(text_col),
        (none if owner is None else owner.cast("string")).alias(own[0]), (none if repo is None else repo.cast("string")).alias(own[1]),
    )
    found = find_secrets(held, text_col, out="found").select(
        common.col(id_col).alias("id"), common.col(own[0]).alias("owner"), common.col(own[1]).alias("repo"), "found"
    )
    # the row number is fixed by the checkpoint
    rows = common.saved(found.withColumn("row", F.monotonically_increasing_id()))
    values = rows.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    held_by = ownership(values)
    judged = (
        values.join(held_by, "value_hash")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct(
            "start", "listed", "kind", "end", verdict(F.col("generated"), F.col("n_owners"), F.col("n_repos")).alias("verdict"), "n_owners", "n_repos"
        ))).alias("spans"))
    )
    joined = rows.select("row", "id").join(judged, "row", "left")
    kind = judged.schema["spans"].dataType
    return joined.select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def _is_kind(name: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == name


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; a source is an owner, its documents of one language a
    repository."""
    docs = common.table(spark, sf_dir, "documents")
    judged = judge_secrets(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    text = lambda spans: F.array_join(F.transform(spans, place), ",")
    base = F.filter("spans", lambda s: s["listed"] < len(BASE))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return judged.select(
        "doc_id",
        *(count(_is_kind(k)).alias(f"n_{k}") for k in BASE),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["verdict"]), ",").alias("verdicts"),
        F.array_join(F.transform("spans", lambda s: s["n_owners"].cast("string")), ",").alias("n_owners"),
        F.array_join(F.transform("spans", lambda s: s["n_repos"].cast("string")), ",").alias("n_repos"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
    )


def _oracle() -> str:
    """The same in SQL: matches and the pieces between them give the places."""
    patterns = {
        "assign": """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]{12,}",
        "hex": "[0-9a-f]{32,}",
        "github": "gh[pousr]_[A-Za-z0-9]{36,}",
        "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
        "jwt": "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}",
        "private_key": "-----BEGIN\\x20(?:[A-Z]{2,10}\\x20)?PRIVATE\\x20KEY-----",
    }
    parts = "\n  UNION ALL ".join(
        f"SELECT rid, {_LISTED[k]} AS listed, '{k}' AS kind, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps, "
        f"regexp_extract_all(t, '{p}', {1 if k == 'assign' else 0}) AS vs FROM d"
        for k, p in patterns.items()
    )
    text = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, listed){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o, concat_ws('/', source, lang) AS r FROM documents),
m AS ({parts}),
u AS (SELECT rid, listed, kind, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1:len(ms)]) AS p, unnest(range(len(ms))) AS i FROM m WHERE len(ms) > 0),
x AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY rid, listed ORDER BY i) AS e FROM u),
c AS (SELECT rid, listed, kind, (e - length(m))::BIGINT AS s, e::BIGINT AS e, sha256(v) AS h,
    len(list_distinct(string_split(v, ''))) >= 9 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{_FAKE}') AS g
  FROM x WHERE kind <> 'assign' OR length(v) >= 8),
f AS (SELECT h, count(DISTINCT o) AS owners, count(DISTINCT row(o, r)) AS repos FROM c JOIN d USING (rid) GROUP BY h),
j AS (SELECT c.*, owners, repos, CASE WHEN owners >= {EXAMPLE_OWNERS} OR repos >= {EXAMPLE_REPOS} THEN 'example' WHEN g AND owners = 1 THEN 'live' ELSE 'unclear' END AS verdict FROM c JOIN f USING (h)),
a AS (SELECT rid, {counts}, sha256({text.format(" FILTER (listed < 3)")}) AS base_sha256, {text.format("")} AS spans,
    string_agg(verdict, ',' ORDER BY s, listed) AS verdicts, string_agg(owners, ',' ORDER BY s, listed) AS n_owners, string_agg(repos, ',' ORDER BY s, listed) AS n_repos, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
  FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(verdicts, '') AS verdicts, coalesce(n_owners, '') AS n_owners, coalesce(n_repos, '') AS n_repos, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN a USING (rid)
"""


ORACLE = _oracle()

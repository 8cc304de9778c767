"""Mixing a corpus to target marginals by iterative proportional fitting, then sampling.

Documents are counted into cells (one per combination of source, language and topic) with
their token weights. A value's target is what its part of the budget gives, but never more than
the value holds; what that cuts off is spread over the values with room. Raking scales the
cells in turn to the target marginal of each dimension. A cell's weight is its scaled number,
at most what it holds; the number itself goes on above that, so that full cells stay full while
others make up for them. Raking ends when every marginal is within ``TOLERANCE`` of its target,
or after ``ROUNDS`` rounds where cells leave no such solution; ``marginals`` gives target and
reached weight of every value either way. A cell's weight over its tokens is a sampling
probability: a document is kept when its hashed uniform number is below its cell's.

SQL functions only. Weights are whole thousandths of a token, so sums are exact and the same
sample comes out whatever the order of rows, partitions or retries. Documents are counted
with pre-aggregation; only cells are shuffled between rounds, and a dimension's hot value is
a pre-aggregated sum joined back.

Defined results: a null dimension value is a value of its own; a null or empty text has no
tokens and is kept by its cell's probability (1 in a cell without tokens); the uniform number
comes from the id, or the text where there is no id, so rows that repeat an id go together;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

#: Share of all tokens that the mixture keeps, and the exponent that flattens each marginal.
KEEP, TEMPERATURE = 0.5, 0.7
#: A marginal's largest error against its target, and the rounds after which raking ends anyway.
TOLERANCE, ROUNDS = 0.005, 60
SEED = "mix-1"
#: Thousandths of a token.
UNIT = 1000
#: Cell tables up to so many rows (and sums over them) are broadcast, larger ones joined by shuffle.
BROADCAST_CELLS = 50_000
#: Cells of a checkpoint partition.
PART_CELLS = 100_000


def topic_of(text: Column) -> Column:
    """A coarse topic by marks in the text: table, license, contact or prose."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("License")), "license")
        .when(F.contains(text, F.lit("@")) | text.rlike(r"\+[0-9]"), "contact")
        .otherwise("prose")
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def uniform(id_: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that follows from the id (the text where it is null) and the seed."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long").cast("double") / 4294967296.0


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def tempered(cells: DataFrame, dim: str, temperature: float = TEMPERATURE) -> DataFrame:
    """Target parts of a dimension's values: tokens to the power of the temperature."""
    sums = cells.groupBy(dim).agg(F.sum("n").alias("n"))
    return sums.select(dim, _half_up(F.pow(F.col("n").cast("double"), F.lit(temperature)) * 1000.0).alias("part"))


def _whole(df: DataFrame, column: str) -> int:
    return int(df.agg(F.sum(column)).first()[0] or 0)


def feasible(cells: DataFrame, dim: str, target: DataFrame, keep: float = KEEP) -> DataFrame:
    """``(dim, want)``: the parts of ``target`` scaled so that they add up to ``keep`` of all
    tokens, in thousandths. No value gets more than it holds; the rest takes up what that cuts
    off, as long as some value has room. Each step is one sum over the values."""
    part = target.groupBy(dim).agg(F.sum("part").alias("part"))
    now = cells.groupBy(dim).agg((F.sum("n") * UNIT).alias("cap")).join(part, dim, "left").fillna(0, ["part"])
    now = common.saved(now.withColumn("full", F.lit(False)))
    budget = float(_whole(now, "cap")) * keep
    while True:
        held = now.agg(F.sum(F.when(F.col("full"), F.col("cap"))).alias("full"), F.sum(F.when(~F.col("full"), F.col("part"))).alias("open")).first()
        scale = (budget - float(held["full"] or 0)) / float(held["open"]) if held["open"] else 0.0
        wanted = F.col("part").cast("double") * F.lit(scale)
        over = ~F.col("full") & (F.col("part") > 0) & (wanted >= F.col("cap").cast("double"))
        marked = now.withColumn("full", F.col("full") | over)
        if not now.filter(over).limit(1).count():
            return now.select(dim, F.when(F.col("full"), F.col("cap").cast("double")).otherwise(wanted).alias("want"))
        now = common.saved(marked)


def marginals(raked: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``(dimension, value, target, reached)`` of raked cells, in thousandths of a token. Values
    are as ``mix`` keys them: empty for null, else after ``=``."""
    out = None
    for d in dims:
        one = raked.groupBy(F.col(d).alias("value")).agg(F.first(f"want_{d}").alias("target"), F.sum("w").alias("reached"))
        one = one.select(F.lit(d).alias("dimension"), F.col("value").cast("string").alias("value"), "target", "reached")
        out = one if out is None else out.unionByName(one)
    return out


def _residual(raked: DataFrame, dims: Sequence[str]) -> float:
    off = F.abs(F.col("reached") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
    return float(marginals(raked, dims).agg(F.max(off)).first()[0] or 0.0)


def rake(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, DataFrame], keep: float = KEEP, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dims, n) with ``w``, raked weights in thousandths of a token, 0 <= w <= UNIT *
    n, and ``want_<dim>``, the targets of the cell's values.

    ``targets`` gives for each dimension a (value, part) table; parts are scaled so that the
    mixture holds ``keep`` of all tokens (``feasible``). A value without a part gets none.
    """
    now = cells.withColumn("w", F.col("n") * UNIT).withColumn("x", F.col("w").cast("double"))
    for d in dims:
        now = now.join(feasible(cells, d, targets[d], keep).withColumnRenamed("want", f"want_{d}"), d)
    now = common.saved(now)
    rows = now.count()
    small, parts = rows <= BROADCAST_CELLS, max(1, -(-rows // PART_CELLS))
    for _ in range(rounds if rows else 0):
        for d in dims:
            has = now.groupBy(d).agg(F.sum("w").alias("has"))
            scaled = F.when(F.col("has") > 0, F.col("x") * F.col(f"want_{d}") / F.col("has").cast("double")).otherwise(F.lit(0.0))
            now = now.join(F.broadcast(has) if small else has, d).withColumn("x", scaled).drop("has")
            now = now.withColumn("w", F.least(F.col("n") * UNIT, _half_up(F.least("x", F.lit(2.0**62)))))
        now = common.saved(now.coalesce(parts))
        if _residual(now, dims) <= tolerance:
            break
    return now.drop("x")


def mix(docs: DataFrame, dims: Mapping[str, Column], tokens: Column, id_col: str = "doc_id", text_col: str = "text",
        targets: Mapping[str, DataFrame] | None = None, keep: float = KEEP, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` with one more column, ``mix``: struct<the dimensions, n_tokens, weight,
    probability, kept> (``weight`` is the document's calibrated tokens).

    ``dims`` names the dimensions and gives their values, ``targets`` their (value, part)
    tables; a dimension without one is tempered.
    """
    names, out = list(dims), "mix"
    key = {d: F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string"))) for d, c in dims.items()}
    cells = common.saved(docs.select(*(key[d].alias(d) for d in names), tokens.alias("n")).groupBy(*names).agg(F.sum("n").alias("n")))
    given = targets or {}
    for_dim = {
        d: given[d].select(F.when(F.col(d).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(d).cast("string"))).alias(d), "part")
        if d in given else tempered(cells, d, temperature) for d in names
    }
    raked = rake(cells, names, for_dim, keep).withColumn(
        "p", F.when(F.col("n") > 0, F.col("w").cast("double") / (F.col("n") * UNIT).cast("double")).otherwise(1.0)
    ).select(F.struct(*names).alias("cell"), "p")
    if cells.count() <= BROADCAST_CELLS:
        raked = F.broadcast(raked)
    cell, prob = common.free_name(docs, "cell"), common.free_name(docs, "p")
    raked = raked.select(F.col("cell").alias(cell), F.col("p").alias(prob))
    own = docs.withColumn(cell, F.struct(*(key[d].alias(d) for d in names)))
    joined = own.join(raked, cell)
    u = uniform(common.col(id_col), common.col(text_col))
    held = F.struct(
        *(c.alias(d) for d, c in dims.items()), tokens.alias("n_tokens"),
        (tokens.cast("double") * F.col(prob)).alias("weight"), F.col(prob).alias("probability"), (u < F.col(prob)).alias("kept"),
    )
    return joined.withColumn(out, held).select(*(common.col(c) for c in docs.columns if c != out), out)


def _documents(docs: DataFrame) -> DataFrame:
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}
    return mix(docs, dims, word_count(F.col("text")))


def sample_mixture(docs: DataFrame) -> DataFrame:
    """The documents that the calibrated mixture keeps, with exactly their columns. A column
    named ``mix`` is set aside meanwhile."""
    spare = common.free_name(docs, "mix_")
    held = _documents(docs.withColumnRenamed("mix", spare)) if "mix" in docs.columns else _documents(docs)
    kept = held.filter("mix.kept").drop("mix")
    return (kept.withColumnRenamed(spare, "mix") if "mix" in docs.columns else kept).select(*map(common.col, docs.columns))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, calibrated probability and whether the sample keeps it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return _documents(docs).select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.n_tokens", "mix.weight", "mix.probability", "mix.kept")


def _oracle() -> str:
    """The same steps: targets by the order in which values fill up, rounds by recursion."""
    dims = ("source", "lang", "topic")
    steps = []
    for d in dims:
        scaled = f"CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN x * t_{d} / (sum(w) OVER (PARTITION BY {d}))::DOUBLE ELSE 0.0 END"
        steps.append(f"(SELECT * EXCLUDE (x, w), x, least(n * {UNIT}, floor(least(x, {2.0**62!r}) + 0.5)::BIGINT) AS w FROM (SELECT * REPLACE ({scaled} AS x) FROM {{}}))")
    body = "s"
    for step in steps:
        body = step.format(body)
    off = ", ".join(f"abs(sum(w) OVER (PARTITION BY {d}) - t_{d}) / greatest(t_{d}, 1.0)" for d in dims)
    parts = ", ".join(
        f"""v_{d} AS MATERIALIZED (SELECT {d}, (sum(n) * {UNIT})::BIGINT AS cap, floor(pow(sum(n)::DOUBLE, {TEMPERATURE}) * 1000.0 + 0.5)::BIGINT AS part FROM c GROUP BY {d}),
l_{d} AS MATERIALIZED (SELECT *, ((SELECT sum(cap) FROM v_{d})::DOUBLE * {KEEP} - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(part) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS scale, row_number() OVER w AS place
  FROM v_{d} WHERE part > 0 WINDOW w AS (ORDER BY cap::DOUBLE / part, {d})),
k_{d} AS MATERIALIZED (SELECT scale, place FROM l_{d} WHERE part::DOUBLE * scale < cap::DOUBLE ORDER BY place LIMIT 1),
p_{d} AS MATERIALIZED (SELECT {d}, CASE WHEN part = 0 THEN 0.0 WHEN place < (SELECT place FROM k_{d}) THEN cap::DOUBLE ELSE part::DOUBLE * (SELECT scale FROM k_{d}) END AS want
  FROM v_{d} LEFT JOIN (SELECT {d} AS q, place FROM l_{d}) ON {d} IS NOT DISTINCT FROM q)""" for d in dims
    )
    want = ", ".join(f"p_{d}.want AS t_{d}" for d in dims)
    joins = " ".join(f"JOIN p_{d} ON c.{d} IS NOT DISTINCT FROM p_{d}.{d}" for d in dims)
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'License') THEN 'license'
    WHEN contains(text, '@') OR regexp_matches(text, '\+[0-9]') THEN 'contact' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM documents),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n)::BIGINT AS n FROM d GROUP BY ALL),
{parts},
rounds AS (
  SELECT 0 AS i, false AS done, c.source, c.lang, c.topic, n, {want}, (n * {UNIT})::DOUBLE AS x, (n * {UNIT})::BIGINT AS w FROM c {joins}
  UNION ALL
  SELECT i + 1, max(off) OVER () <= {TOLERANCE}, source, lang, topic, n, {", ".join(f"t_{d}" for d in dims)}, x, w FROM (
    SELECT *, greatest({off}) AS off FROM {body.replace("FROM s)", f"FROM rounds WHERE NOT done AND i < {ROUNDS})")})
),
f AS (SELECT source, lang, topic, CASE WHEN n > 0 THEN w::DOUBLE / (n * {UNIT})::DOUBLE ELSE 1.0 END AS p FROM rounds WHERE i = (SELECT max(i) FROM rounds))
SELECT doc_id, d.source, d.lang, d.topic, d.n AS n_tokens, d.n::DOUBLE * p AS weight, p AS probability, u < p AS kept
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic
"""


ORACLE = _oracle()

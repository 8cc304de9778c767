"""Personal data in texts: patterns propose spans, checksums confirm them, context adjusts.

SQL functions only: each kind has a Java pattern (possessive and anchored at the start of a
run, so a text is scanned in linear time and without deep recursion), a check on the match
(parts of an address, digit counts, Luhn, mod-97) and a score that words shortly before the
match raise. The base kinds (email, ip, card, phone) always stay; the further kinds (iban,
short_card, ssn, local_phone) must reach ``THRESHOLD`` and lie outside every base span.

Defined results: a null or empty text has no spans; every row is judged by itself, repeated
rows and null ids included; an empty table gives an empty result; further columns and their
names do not matter. Whole texts are scanned, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.spans import count_kind, let, pattern_spans, replace_matches, span_text

#: Code points before a match that are searched for context words.
CONTEXT = 40
THRESHOLD = 0.5
_LOCAL = "A-Za-z0-9._%+-"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 1 to 30 digits passes the Luhn check."""

    def total(s: Column) -> Column:
        n = F.length(s)
        value = lambda i: F.substring(s, n - i + 1, F.lit(1)).cast("int")
        doubled = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + doubled(i))

    ok = F.length(number).between(1, 30)
    return F.coalesce(F.when(ok, let(number, total) % 10 == 0), F.lit(False))


def mod97(account: Column) -> Column:
    """Whether an account number of capital letters and digits has the remainder 1."""

    def rest(s: Column) -> Column:
        n = F.length(s)
        turned = F.concat(F.substring(s, F.lit(5), n), F.substring(s, 1, 4))
        code = lambda t, i: F.ascii(F.substring(t, i, F.lit(1)))
        step = lambda acc, c: F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)
        return let(turned, lambda t: F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: let(code(t, i), lambda c: step(acc, c))))

    ok = account.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    return F.coalesce(F.when(ok, let(account, rest) == 1), F.lit(False))


@dataclass(frozen=True)
class Kind:
    """``guard`` finds no place in a text without a match; ``valid`` confirms a match."""

    name: str
    pattern: str
    guard: str
    valid: Callable[[Column], Column]
    score: float
    words: str
    raised: float
    base: bool = False


def _digit_count(low: int, high: int, also: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    def check(m: Column) -> Column:
        return let(digits(m), lambda d: F.when(F.length(d).between(low, high), also(d) if also else F.lit(True)).otherwise(False))

    return check


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_CARD = r"[0-9](?:[ -]?+[0-9])++"
_CARD_GUARD = r"(?:[0-9][ -]?){13}"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, "mail|contact|write", 1.0, base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6, r"\bip\b|address|host|server", 0.9, base=True),
    Kind("card", _CARD, _CARD_GUARD, _digit_count(16, 19, luhn), 0.8, "card|visa|credit|debit|pay", 1.0, base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _digit_count(8, 15), 0.7, "phone|tel|call|mobile|fax|whatsapp", 1.0, base=True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), 0.9, "iban|account|bank", 1.0),
    Kind("short_card", _CARD, _CARD_GUARD, _digit_count(13, 15, luhn), 0.4, "card|visa|amex|credit|debit", 0.8),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: F.lit(True), 0.3, "ssn|social security", 0.9),
    Kind("local_phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}", lambda m: F.lit(True), 0.3, "phone|tel|call|mobile|fax|whatsapp", 0.7),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _guard(text: Column, kind: Kind) -> Column:
    return F.contains(text, F.lit("@")) if kind.guard == "@" else text.rlike(kind.guard)


def _score(kind: Kind, before: Column) -> Column:
    return F.when(F.lower(before).rlike(kind.words), F.lit(kind.raised)).otherwise(F.lit(kind.score))


def _confirmed(kind: Kind, match: Column, before: Column) -> Column:
    """Base kinds by their check alone; the others also by their score."""
    return kind.valid(match) if kind.base else kind.valid(match) & (_score(kind, before) >= THRESHOLD)


def kind_spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind: array of kind, start, end, score."""
    found = F.filter(pattern_spans(text, kind.name, kind.pattern, _guard(text, kind), CONTEXT), lambda s: _confirmed(kind, s["match"], s["before"]))
    return F.transform(found, lambda s: F.struct(s["kind"], s["start"], s["end"], _score(kind, s["before"]).alias("score")))


def find_pii(df: DataFrame, text_col: str = "text", out: str = "spans", base_out: str | None = None) -> DataFrame:
    """``df`` with its spans: array<struct<kind, start, end, score>> by kind, then start.

    ``base_out`` also keeps the array of base spans under that name.
    """
    text, base = common.col(text_col), common.free_name(df, "base_spans")
    kinds = [common.free_name(df, f"{k.name}_spans") for k in KINDS]
    found = df.withColumns({c: kind_spans(text, k) for c, k in zip(kinds, KINDS)})
    found = found.withColumn(base, F.concat(*(common.col(c) for c, k in zip(kinds, KINDS) if k.base)))
    apart = lambda s: ~F.exists(common.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.concat(*(common.col(c) for c, k in zip(kinds, KINDS) if not k.base))
    found = found.withColumn(out, F.concat(common.col(base), F.filter(added, apart)))
    if base_out and base_out != base:
        found = found.withColumn(base_out, common.col(base))
    return found.drop(*kinds, *([base] if base_out != base else []))


def _mask(text: Column, name: str) -> Column:
    """The text with the confirmed matches of one kind replaced."""
    k = next(k for k in KINDS if k.name == name)
    return replace_matches(text, k.pattern, _guard(text, k), lambda m, b: _confirmed(k, m, b), f"<{name.upper()}>", CONTEXT)


def _holds_base(text: Column) -> Column:
    """Whether a text holds a confirmed match of a base kind."""
    held = [_guard(text, k) & F.exists(F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)), k.valid) for k in KINDS if k.base]
    return reduce(Column.__or__, held)


#: Masking order, containing ones first; the further kinds wait until no base match is left.
_FIRST, _NEXT = ("email", "card", "phone", "ip"), ("iban", "short_card", "ssn", "local_phone")


def _mask_on(text: Column) -> Column:
    """The text masked kind by kind, from the first one again while a base kind matches.

    One step a kind, and one after the base kinds and after all kinds that looks for a base
    match. Nothing matches in ``<KIND>``, so each round but the last takes a base match of at
    least five code points of the text itself, and the steps suffice for any text.
    """
    steps = (*_FIRST, None, *_NEXT, None)
    done = len(steps)

    def step(s: Column) -> Column:
        put, to = s["t"], s["at"] + 1
        for i, name in enumerate(steps):
            if name:
                put = F.when(s["at"] == i, _mask(s["t"], name)).otherwise(put)
        look = reduce(Column.__or__, (s["at"] == i for i, name in enumerate(steps) if not name))
        to = F.when(look, F.when(_holds_base(s["t"]), F.lit(0)).otherwise(to)).otherwise(to)
        return F.when(s["at"] < done, F.struct(put.alias("t"), to.alias("at"))).otherwise(s)

    rounds = F.floor(F.length(text) / 5).cast("int") + 2
    start = F.struct(text.alias("t"), F.lit(0).alias("at"))
    return F.aggregate(F.sequence(F.lit(1), rounds * done), start, lambda s, _: step(s), lambda s: s["t"])


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with every confirmed match replaced by ``<KIND>``; same columns, same rows.

    The kinds are masked one after the other. What a replaced match leaves of a run around it
    can match itself; such texts are masked on until no base kind matches, so the masked text
    holds no match of any base kind. ``length_col``, where there is one, becomes the new length.
    """
    out, text, again = docs, common.col(text_col), common.free_name(docs, "again")
    for name in _FIRST:
        out = out.withColumn(text_col, _mask(text, name))
    out = out.withColumn(again, _holds_base(text))
    for name in _NEXT:
        out = out.withColumn(text_col, F.when(common.col(again), text).otherwise(_mask(text, name)))
    out = out.withColumn(text_col, F.when(common.col(again) | _holds_base(text), _mask_on(text)).otherwise(text))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text).cast(docs.schema[length_col].dataType))
    return out.select(*map(common.col, docs.columns))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, digest and spans."""
    found = find_pii(common.table(spark, sf_dir, "documents").select("doc_id", "text"), base_out="base_spans")
    return found.select(
        "doc_id",
        *(count_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in BASE),
        F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )

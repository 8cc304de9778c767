"""Spans of pattern matches in a text column, with SQL functions only.

A text is split at a pattern and its matches are extracted; both see the same leftmost
non-overlapping matches, so pieces and matches alternate and the lengths of both give the
places. Places are code points from 0, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lists up to this length are summed in one block; longer ones in blocks of about the root
#: of their length, so the work stays near linear for very long lists.
_ROOT_MIN = 32

SPAN = "array<struct<kind:string,start:long,end:long,match:string,before:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_total(lengths: Column) -> Column:
    """For ``array<long>`` of n values, the n sums of the values up to and at each place."""
    zero = F.lit(0).cast("long")
    sums = lambda xs: F.aggregate(
        xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    )

    def blocks(xs: Column) -> Column:
        n = F.size(xs)
        size = F.greatest(F.lit(_ROOT_MIN), F.ceil(F.sqrt(n.cast("double")))).cast("int")
        return let(size, lambda k: F.transform(
            F.sequence(F.lit(1), n, k), lambda s: let(F.slice(xs, s, k), lambda part: F.slice(sums(part), 2, F.size(part)))
        ))

    def joined(bs: Column) -> Column:
        bases = sums(F.transform(bs, lambda b: F.element_at(b, -1)))
        return let(bases, lambda base: F.flatten(F.transform(bs, lambda b, i: let(F.get(base, i), lambda z: F.transform(b, lambda x: x + z)))))

    some = let(lengths, lambda xs: F.when(F.size(xs) > 0, let(blocks(xs), joined)))
    return F.coalesce(some, F.array().cast("array<long>"))


def _parts(text: Column, pattern: str) -> Column:
    """Matches ``m`` and the pieces ``p`` around them (one more than matches)."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))


def _before(x: Column, context: int) -> Column:
    """For each match of ``_parts`` the up to ``context`` code points of the text before it.

    A piece that is too short is completed from what precedes it: a match and its piece have
    a code point at least, so ``context`` of them always suffice, and each match costs the same.
    """
    tail = lambda s: F.right(s, F.lit(context))
    pieces = F.slice(x["p"], 1, F.size(x["m"]))
    if not context:
        return F.transform(pieces, lambda p: F.lit(""))
    tails = F.zip_with(pieces, x["m"], lambda p, m: tail(F.concat(tail(p), tail(m))))
    earlier = lambda t, i: F.array_join(F.slice(t, F.greatest(i - context, F.lit(0)) + 1, F.least(i, F.lit(context))), "")
    whole = lambda t, p, i: F.when(F.length(p) >= context, tail(p)).otherwise(tail(F.concat(earlier(t, i), p)))
    return let(tails, lambda t: F.transform(pieces, lambda p, i: whole(t, p, i)))


def pattern_spans(text: Column, kind: str, pattern: str, guard: Column, context: int = 0) -> Column:
    """All matches of a Java pattern as an array of kind, start, end, match, before.

    ``guard`` is a cheap condition without which the pattern cannot match; the pattern runs
    only where it holds. ``before`` holds up to ``context`` code points of the text that precede
    the match, other matches included.
    """
    lengths = lambda x: F.zip_with(
        x["m"], F.slice(x["p"], 1, F.size(x["m"])), lambda m, p: (F.length(p) + F.length(m)).cast("long")
    )
    spans = lambda x, ends: F.zip_with(
        F.zip_with(x["m"], _before(x, context), lambda m, b: F.struct(m.alias("m"), b.alias("b"))),
        ends,
        lambda r, e: F.struct(
            F.lit(kind).alias("kind"),
            (e - F.length(r["m"])).alias("start"),
            e.alias("end"),
            r["m"].alias("match"),
            r["b"].alias("before"),
        ),
    )
    found = let(_parts(text, pattern), lambda x: let(running_total(lengths(x)), lambda ends: spans(x, ends)))
    return F.coalesce(F.when(guard, found).cast(SPAN), F.array().cast(SPAN))


def replace_matches(text: Column, pattern: str, guard: Column, valid: Callable[[Column, Column], Column], by: str, context: int = 0) -> Column:
    """The text with every match for which ``valid(match, before)`` holds replaced; linear in
    the text and its matches."""

    def put(x: Column) -> Column:
        marked = F.zip_with(x["m"], _before(x, context), lambda m, b: F.when(valid(m, b), F.lit(by)).otherwise(m))
        pairs = F.zip_with(F.slice(x["p"], 1, F.size(x["m"])), marked, lambda p, m: F.concat(p, m))
        return F.concat(F.array_join(pairs, ""), F.element_at(x["p"], -1))

    return F.when(guard, let(_parts(text, pattern), put)).otherwise(text)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

"""Column-name handling on the driver: normalization (P1) and lookup."""

from __future__ import annotations

from quarry.functions.tokens import COLUMN_SYNONYMS


def normalize_name(name: str) -> str:
    """Strip, drop spaces and dots, lowercase."""
    return str(name).strip().replace(" ", "").replace(".", "").lower()


def normalize_names(names: list[str]) -> tuple[list[str], dict[str, str]]:
    """Clean names plus the clean -> original map; a collision is an error naming the originals."""
    clean = [normalize_name(n) for n in names]
    seen: dict[str, list[str]] = {}
    for c, o in zip(clean, names):
        seen.setdefault(c, []).append(o)
    clashes = {c: o for c, o in seen.items() if len(o) > 1}
    if clashes:
        detail = "; ".join(f"{c!r} <- {', '.join(repr(x) for x in o)}" for c, o in clashes.items())
        raise ValueError(f"column names collide after normalization: {detail}")
    return clean, dict(zip(clean, names))


def resolve_column(target: str | None, columns: list[str]) -> str | None:
    """The column that a plan's name means: the best-ranked candidate, None without one.

    Candidates rank by kind of match (equal but for case, one name within the other, holding
    a synonym), synonyms by their order, then columns by their position.
    """
    wanted = (target or "").lower()
    if not wanted:
        return None
    synonyms = COLUMN_SYNONYMS.get(wanted, [])

    def ranked(place: int, name: str):
        if name == wanted:
            yield 0, 0, place
        if wanted in name or name in wanted:
            yield 1, 0, place
        yield from ((2, order, place) for order, s in enumerate(synonyms) if s in name)

    best = min((r for place, c in enumerate(columns) for r in ranked(place, c.lower())), default=None)
    return None if best is None else columns[best[-1]]

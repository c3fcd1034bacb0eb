"""SQL text for constants. One parsed expression is far quicker to build than one column per
constant when a word list has hundreds of entries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def literal(value: str | float | int | None) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return f"{value!r}D" if isinstance(value, float) else f"{value}"


def words(items: Iterable[str]) -> str:
    return ", ".join(literal(item) for item in items)


def rating(token: str, ratings: Mapping[str, float]) -> str:
    """CASE over a token's rating, 0 if it has none: one hash-set test per distinct rating."""
    groups: dict[float, list[str]] = {}
    for word, value in ratings.items():
        groups.setdefault(float(value), []).append(word)
    if not groups:
        return "0D"
    cases = " ".join(
        f"WHEN {token} IN ({words(group)}) THEN {literal(value)}" for value, group in groups.items()
    )
    return f"CASE {cases} ELSE 0D END"

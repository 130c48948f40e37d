"""Query trees to SQL over the rows of a search view; the oracle of the Spark plans."""

from __future__ import annotations

from datetime import datetime

from quirefold.lang.tree import Category, Clause, Op
from quirefold.plans.predicate import LEAST_TEXT, predicate


def literal(value: str | datetime) -> str:
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    return "'" + value.replace("'", "''") + "'"


class SqlNotation:
    def __init__(self, names: dict[Category, str]) -> None:
        self.names = names

    def isin(self, category: Category, values: list[str], negated: bool) -> str:
        return f"{self.names[category]} {'NOT ' * negated}IN ({', '.join(map(literal, values))})"

    def contains(self, category: Category, text: str, negated: bool) -> str:
        c = self.names[category]
        found = f"contains(lower({c}), lower({literal(text)}))" if len(text) >= LEAST_TEXT else "FALSE"
        return f"({c} IS NOT NULL AND {'NOT ' * negated}{found})"

    def matches(self, category: Category, pattern: str, negated: bool) -> str:
        c = self.names[category]
        return f"({c} IS NOT NULL AND {'NOT ' * negated}regexp_matches({c}, {literal(pattern)}))"

    def compare(self, category: Category, op: Op, value: str | datetime) -> str:
        return f"{self.names[category]} {op.value} {literal(value)}"

    def between(self, category: Category, low: datetime, high: datetime, negated: bool) -> str:
        return f"{self.names[category]} {'NOT ' * negated}BETWEEN {literal(low)} AND {literal(high)}"

    def join(self, parts: list[str], any_of: bool) -> str:
        return "(" + (" OR " if any_of else " AND ").join(parts) + ")"


def where(tree: Clause, names: dict[Category, str] | None = None) -> str:
    """The condition on a row of the view, whose columns are named like those of the model unless `names` says otherwise."""
    return predicate(tree, SqlNotation({c: (names or {}).get(c, c.value) for c in Category}))

"""Query trees to predicates, for any notation of expressions.

Statements of one clause about one set category fold: all `=` into one IN, all `!=` into one NOT IN, whatever the join of the
clause. Everything else is joined by the join of its clause. Comparisons with null are null, and a row is taken if the whole
is true.
"""

from __future__ import annotations

from typing import Any, Protocol

from quirefold.lang.dates import interval
from quirefold.lang.tree import Category, Clause, Op, Statement

#: Texts looked for by `:` have at least so many characters; shorter ones are found nowhere.
LEAST_TEXT = 3


class Notation(Protocol):
    def isin(self, category: Category, values: list[str], negated: bool) -> Any: ...
    def contains(self, category: Category, text: str, negated: bool) -> Any: ...
    def matches(self, category: Category, pattern: str, negated: bool) -> Any: ...
    def compare(self, category: Category, op: Op, value: Any) -> Any: ...
    def between(self, category: Category, low: Any, high: Any, negated: bool) -> Any: ...
    def join(self, parts: list, any_of: bool) -> Any: ...


def _one(s: Statement, x: Notation) -> Any:
    if s.op is Op.AP:
        if s.category.is_ordered:
            return x.between(s.category, *interval(s.value), s.negated)
        return x.contains(s.category, s.value, s.negated)
    if s.op is Op.RE:
        return x.matches(s.category, s.value, s.negated)
    return x.compare(s.category, s.op, s.value)


def predicate(clause: Clause, x: Notation) -> Any:
    """The predicate of a tree in normal form."""
    parts, folded = [], {}
    for s in clause.statements:
        if s.category.is_set and s.op in (Op.EQ, Op.NE):
            folded.setdefault((s.category, s.op), []).append(s.value)
        else:
            parts.append(_one(s, x))
    parts += [x.isin(c, list(dict.fromkeys(v)), op is Op.NE) for (c, op), v in folded.items()]
    parts += [predicate(c, x) for c in clause.clauses]
    return x.join(parts, clause.any_of)

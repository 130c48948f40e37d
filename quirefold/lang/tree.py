"""The query tree: statements about categories, joined by clauses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum


class Category(Enum):
    """What a statement is about. The value is the column of the document model."""

    PATH = "path"
    TITLE = "title"
    AUTHOR = "authors"
    DATE = "date"
    FILETIME = "filetime"
    TAGS = "tags"
    HEADINGS = "headings"
    LINKS = "links"
    META = "meta"

    @property
    def is_set(self) -> bool:
        return self in (Category.AUTHOR, Category.TAGS, Category.LINKS)

    @property
    def is_ordered(self) -> bool:
        return self in (Category.DATE, Category.FILETIME)


class Op(Enum):
    EQ = "="
    NE = "!="
    AP = ":"
    RE = "/"
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="


#: The operator that is true exactly where another is false, on values that are not null.
OPPOSITE = {Op.EQ: Op.NE, Op.NE: Op.EQ, Op.LT: Op.GE, Op.GE: Op.LT, Op.LE: Op.GT, Op.GT: Op.LE}
TEXT_OPS = {Op.EQ, Op.NE, Op.AP, Op.RE}
DATE_OPS = {Op.EQ, Op.NE, Op.AP, Op.LT, Op.LE, Op.GT, Op.GE}

#: How categories are written.
CATEGORY_NAMES = {
    "p": Category.PATH, "path": Category.PATH,
    "T": Category.TITLE, "title": Category.TITLE,
    "a": Category.AUTHOR, "author": Category.AUTHOR,
    "d": Category.DATE, "date": Category.DATE,
    "f": Category.FILETIME, "filetime": Category.FILETIME,
    "t": Category.TAGS, "tags": Category.TAGS,
    "h": Category.HEADINGS, "headings": Category.HEADINGS,
    "l": Category.LINKS, "links": Category.LINKS,
    "m": Category.META, "meta": Category.META,
}


@dataclass(frozen=True)
class Statement:
    category: Category
    op: Op
    value: str | datetime
    negated: bool = False

    def __str__(self) -> str:
        v = self.value.isoformat(sep=" ") if isinstance(self.value, datetime) else self.value
        return f"{'-' * self.negated}{self.category.value}{self.op.value}\"{v}\""


@dataclass
class Clause:
    """Statements, then clauses, joined by `and` or by `or`."""

    any_of: bool = False
    statements: list[Statement] = field(default_factory=list)
    clauses: list[Clause] = field(default_factory=list)

    def depth(self) -> int:
        """Levels of clauses; no recursion, so that the depth of a query text cannot exhaust the stack."""
        deepest, stack = 0, [(self, 1)]
        while stack:
            c, d = stack.pop()
            deepest = max(deepest, d)
            stack += [(x, d + 1) for x in c.clauses]
        return deepest

    def walk(self) -> Iterator[Clause]:
        """Depth first, parents before children."""
        stack = [self]
        while stack:
            c = stack.pop()
            yield c
            stack += reversed(c.clauses)

    def levels(self) -> Iterator[Clause]:
        """Breadth first."""
        level = [self]
        while level:
            yield from level
            level = [x for c in level for x in c.clauses]

    def order(self) -> int:
        """The number of clauses."""
        return sum(1 for _ in self.walk())

    def categories(self) -> set[Category]:
        return {s.category for c in self.walk() for s in c.statements}

    def __str__(self) -> str:
        parts = [str(s) for s in self.statements] + [str(c) for c in self.clauses]
        return f"({'or' if self.any_of else 'and'} {' '.join(parts)})"

    def pretty(self, indent: int = 0) -> str:
        pad = "  " * indent
        lines = [f"{pad}({'or' if self.any_of else 'and'}"]
        lines += [f"{pad}  {s}" for s in self.statements] + [c.pretty(indent + 1) for c in self.clauses]
        return "\n".join(lines) + f"\n{pad})"

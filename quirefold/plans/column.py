"""Query trees to Spark columns.

A document is taken if one tuple of an author, a tag and a link of it (null for an empty set) makes the whole tree true. That
is `exists` over each set the tree names, nested at the root, around the predicate: no explode, no distinct, no shuffle.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.lang.parser import QueryError
from quirefold.lang.tree import Category, Clause, Op
from quirefold.plans.predicate import LEAST_TEXT, predicate


def java_regex(pattern: str) -> str:
    """A regular expression of the query language (linear-time dialect) for Java: `.` stops at a line feed only, `$` is the
    very end, case folding is Unicode's. Back-references and looking around are no part of the language."""
    try:
        re.compile(re.sub(r"\\[pPzQEC]|\(\?<(?=[A-Za-z])", lambda m: "(?P<" if m[0].startswith("(") else "x", pattern))
    except re.error as e:
        raise QueryError(f"bad regular expression {pattern!r}: {e}") from None
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9k]|\(\?(?:<?[=!]|>)", pattern):
        raise QueryError(f"back-references and looking around are not supported: {pattern!r}")
    out, i, in_class = [], 0, False
    multiline = bool(re.match(r"\(\?[a-zA-Z]*m", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]":
            in_class = False
        if c == "$" and not in_class and not multiline:
            c = r"\z"
        elif c == "[" and in_class and out and out[-1] == "[" and i and pattern[i - 1] != "[":
            c = r"\["
        out.append(c)
        i += 1
    body = "".join(out)
    body = re.sub(r"\(\?([a-zA-Z]*)i", r"(?\1iu", body)
    return f"(?d){body}"


def moment(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


class ColumnNotation:
    """Expressions over the given columns of the categories."""

    def __init__(self, columns: dict[Category, Column]) -> None:
        self.columns = columns

    def isin(self, category: Category, values: list[str], negated: bool) -> Column:
        found = self.columns[category].isin(values)
        return ~found if negated else found

    def contains(self, category: Category, text: str, negated: bool) -> Column:
        c = self.columns[category]
        if len(text) < LEAST_TEXT:
            return c.isNotNull() & F.lit(negated)
        found = F.contains(F.lower(c), F.lower(F.lit(text)))
        return c.isNotNull() & (~found if negated else found)

    def matches(self, category: Category, pattern: str, negated: bool) -> Column:
        c = self.columns[category]
        found = c.rlike(java_regex(pattern))
        return c.isNotNull() & (~found if negated else found)

    def compare(self, category: Category, op: Op, value: str | datetime) -> Column:
        c, v = self.columns[category], moment(value) if isinstance(value, datetime) else F.lit(value)
        return {Op.EQ: c == v, Op.NE: c != v, Op.LT: c < v, Op.LE: c <= v, Op.GT: c > v, Op.GE: c >= v}[op]

    def between(self, category: Category, low: datetime, high: datetime, negated: bool) -> Column:
        found = self.columns[category].between(moment(low), moment(high))
        return ~found if negated else found

    def join(self, parts: list[Column], any_of: bool) -> Column:
        return reduce(lambda a, b: a | b, parts) if any_of else reduce(lambda a, b: a & b, parts)


def referenced_sets(tree: Clause) -> list[Category]:
    return sorted((c for c in tree.categories() if c.is_set), key=lambda c: c.name)


def or_null(array: Column) -> Column:
    """A set with null in place of nothing."""
    return F.when(F.size(array) > 0, array).otherwise(F.array(F.lit(None).cast("string")))


def conjuncts(tree: Clause) -> tuple[Clause | None, Clause | None]:
    """A tree as two that must both hold: one without sets, whose comparisons can reach the scan, and the rest."""
    if tree.any_of:
        return (None, tree) if referenced_sets(tree) else (tree, None)
    plain, rest = Clause(), Clause()
    for s in tree.statements:
        (rest if s.category.is_set else plain).statements.append(s)
    for c in tree.clauses:
        (rest if referenced_sets(c) else plain).clauses.append(c)
    some = lambda c: c if c.statements or c.clauses else None
    return some(plain), some(rest)


def exists_column(tree: Clause) -> Column:
    """The condition on a row of the document model; null counts as false."""
    columns = {c: F.col(c.value) for c in tree.categories() if not c.is_set}

    def nest(part: Clause, sets: list[Category]) -> Column:
        if not sets:
            return predicate(part, ColumnNotation(columns))
        first, *rest = sets

        def inner(x: Column) -> Column:
            columns[first] = x
            return nest(part, rest)

        return F.exists(or_null(F.col(first.value)), inner)

    parts = [nest(c, referenced_sets(c)) for c in conjuncts(tree) if c]
    return reduce(lambda a, b: a & b, parts)


def select_documents(docs: DataFrame, tree: Clause) -> DataFrame:
    """The documents a tree takes."""
    return docs.where(exists_column(tree))


def select_by_rows(docs: DataFrame, tree: Clause) -> DataFrame:
    """The same by the rows of the search view: explode the named sets, filter, distinct, semi-join. Kept to be compared with
    the form above; it shuffles."""
    rows = docs.select("doc_id", *[F.col(c.value) for c in tree.categories()])
    for c in referenced_sets(tree):
        rows = rows.withColumn(c.value, F.explode_outer(c.value))
    columns = {c: F.col(c.value) for c in tree.categories()}
    hits = rows.where(predicate(tree, ColumnNotation(columns))).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_semi")

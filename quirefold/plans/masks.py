"""Queries over bridge tables, from the dictionary to the documents.

Documents whose sets lie in bridge tables (rows of document and value, the values often in a dictionary of their own) are
selected without gathering any set. Every statement about a set is one bit, tried once on each value of the dictionary; a value
that meets no statement cannot make any tree true, since negation stands in the operators, so it is dropped with its bridge
rows before any shuffle. What is left of a document's set is the masks of bits its values have: up to BITS statements they are
held as one integer (bit m is set if some value has mask m), combined by bit_or in generated code before and after the shuffle.
The tree is then tried on masks instead of values, with one mask of each set at a time, as in plans.column.

Where the tree cannot be true for a document that has no such value, the join with its masks is inner, otherwise left.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.lang.tree import Category, Clause
from quirefold.operators.skew import sized_join
from quirefold.plans.column import ColumnNotation, conjuncts, exists_column, referenced_sets, select_documents
from quirefold.plans.predicate import predicate

#: Statements about one set whose masks fit in an integer of 64 bits; more are held as a list of masks. Of more than WIDE the
#: sets are gathered.
BITS, WIDE = 6, 62


@dataclass(frozen=True)
class Bridge:
    """The rows (doc_id, value) of a set; with a dictionary (key, value), the rows are (doc_id, key)."""

    rows: DataFrame
    dictionary: DataFrame | None = None

    def values(self) -> DataFrame:
        """(doc_id, value)"""
        return self.rows if self.dictionary is None else self.rows.join(self.dictionary, "key").select("doc_id", "value")


class MaskNotation(ColumnNotation):
    """Statements about sets become tests of bits; tests: per set, the statements as columns over `value`, in the order of bits."""

    def __init__(self, columns: dict[Category, Column]) -> None:
        super().__init__(columns)
        self.tests: dict[Category, list[Column]] = {}
        self.on_values = ColumnNotation({c: F.col("value") for c in Category if c.is_set})

    def _bit(self, category: Category, test: Column) -> Column:
        tests = self.tests.setdefault(category, [])
        tests.append(test)
        bit = min(len(tests), WIDE + 1) - 1  # with more than WIDE the masks are not used
        return self.columns[category].bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0

    def isin(self, category: Category, values: list[str], negated: bool) -> Column:
        return self._bit(category, self.on_values.isin(category, values, negated))

    def contains(self, category: Category, text: str, negated: bool) -> Column:
        if not category.is_set:
            return super().contains(category, text, negated)
        return self._bit(category, self.on_values.contains(category, text, negated))

    def matches(self, category: Category, pattern: str, negated: bool) -> Column:
        if not category.is_set:
            return super().matches(category, pattern, negated)
        return self._bit(category, self.on_values.matches(category, pattern, negated))


class _Without(ColumnNotation):
    """Whether a tree can be true if no statement about one set is, and all others are."""

    def __init__(self, missing: Category) -> None:
        super().__init__({})
        self.missing = missing

    def isin(self, category, values, negated):
        return category is not self.missing

    contains = matches = isin

    def compare(self, category, op, value):
        return True

    def between(self, category, low, high, negated):
        return True

    def join(self, parts, any_of):
        return any(parts) if any_of else all(parts)


def needs(tree: Clause, category: Category) -> bool:
    """Whether only documents with a value of this set that meets a statement can be taken."""
    return not predicate(tree, _Without(category))


def masks(bridge: Bridge, tests: list[Column], name: str) -> DataFrame:
    """(doc_id, name): the masks of a document's values as an array, for documents with a value that meets a test."""
    values = bridge.rows if bridge.dictionary is None else bridge.dictionary
    bits = [F.when(t, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, t in enumerate(tests)]
    mask = reduce(lambda a, b: a.bitwiseOR(b), bits)
    marked = values.where(reduce(lambda a, b: a | b, tests)).withColumn("mask", mask).drop("value")
    rows = marked if bridge.dictionary is None else sized_join(bridge.rows, marked, ["key"])
    grouped = rows.where("doc_id IS NOT NULL").groupBy("doc_id")
    if len(tests) > BITS:
        return grouped.agg(F.collect_set("mask").alias(name))
    if len(tests) == 1:
        return grouped.agg(F.array(F.max("mask")).alias(name))
    there = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("mask").cast("int"))).alias("there")
    has = lambda m: F.call_function("shiftright", F.col("there"), m).bitwiseAND(F.lit(1).cast("bigint")) == 1
    listed = F.filter(F.sequence(F.lit(1), F.lit((1 << len(tests)) - 1)), has)
    return grouped.agg(there).select("doc_id", F.transform(listed, lambda m: m.cast("bigint")).alias(name))


def select_bridged(docs: DataFrame, bridges: dict[Category, Bridge], tree: Clause) -> DataFrame:
    """The documents a tree takes: docs have all columns of the model the tree names but the sets in `bridges`."""
    plain, rest = conjuncts(tree)
    if plain is not None:
        docs = docs.where(exists_column(plain))
    if rest is None:
        return docs
    columns = {c: F.col(c.value) for c in tree.categories() if not c.is_set}
    notation = MaskNotation(columns)

    def nest(sets: list[Category]) -> Column:
        if not sets:
            return predicate(rest, notation)
        first, *others = sets

        def inner(x: Column) -> Column:
            columns[first] = x
            notation.tests.clear()  # a lambda is made more than once; its statements come in the same order
            return nest(others)

        return F.exists(F.coalesce(F.col(f"__{first.value}"), F.array(F.lit(0).cast("bigint"))), inner)

    condition = nest(referenced_sets(rest))
    if max(map(len, notation.tests.values())) > WIDE:
        for c in referenced_sets(rest):
            lists = bridges[c].values().where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("value").alias(c.value))
            docs = docs.join(lists, "doc_id", "left")
        return select_documents(docs, rest).drop(*[c.value for c in referenced_sets(rest)])
    for c in referenced_sets(rest):
        docs = docs.join(masks(bridges[c], notation.tests[c], f"__{c.value}"), "doc_id", "inner" if needs(rest, c) else "left")
    return docs.where(condition).drop(*[f"__{c.value}" for c in referenced_sets(rest)])

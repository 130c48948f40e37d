"""The collection of documents one asks: Corpus(docs).query('t=x d>2024-01-01').sort('date').to('json')."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.lang.parser import compile_tree
from quirefold.lang.tree import Clause
from quirefold.plans.column import select_documents
from quirefold.schema import check_documents
from quirefold.sinks import outputs

#: What results can be sorted by.
SORT_KEYS = ("path", "title", "date", "filetime", "headings", "meta")


class NotFoundError(LookupError):
    """No document has this path."""


class Corpus:
    """Documents, lazily: every step makes a new plan, nothing runs before an action."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = check_documents(docs)

    def query(self, text: str | Clause, level: int = 0) -> Corpus:
        """The documents a query takes; QueryError if the text means nothing."""
        return Corpus(select_documents(self.docs, compile_tree(text, level) if isinstance(text, str) else text))

    def sort(self, key: str | None = None, descending: bool = False) -> Corpus:
        """Sorted by one column, bytewise, missing values smallest, ties by path; an unknown key sorts nothing."""
        if key not in SORT_KEYS:
            return self
        first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
        return Corpus(self.docs.orderBy(first, "path") if key != "path" else self.docs.orderBy(first))

    def slice(self, start: int, stop: int, key: str = "path") -> Corpus:
        """Documents start to stop (not included) in the order of a column."""
        if not 0 <= start <= stop:
            raise IndexError(f"no slice from {start} to {stop}")
        return Corpus(self.sort(key).docs.offset(start).limit(stop - start))

    def at(self, index: int, key: str = "path") -> Corpus:
        return self.slice(index, index + 1, key)

    def get(self, path: str) -> DataFrame:
        """The document at a path; NotFoundError if there is none."""
        found = self.docs.where(F.col("path") == path)
        if found.isEmpty():
            raise NotFoundError(path)
        return found

    def count(self) -> int:
        return self.docs.count()

    def last_modified(self) -> DataFrame:
        """One row: the latest filetime."""
        return self.docs.agg(F.max("filetime").alias("last_modified"))

    def to(self, form: str = "default", **options) -> DataFrame:
        """One row of text per document: default, json, pathonly or custom (see sinks.outputs)."""
        return outputs.render(self.docs, form, **options)

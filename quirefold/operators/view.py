"""The relational operators around the search view, on documents and on the bridge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.schema import SETS


def search_view(docs: DataFrame, sets: tuple[str, ...] = SETS) -> DataFrame:
    """One row per author, tag and link of a document, null where it has none. Grows with the product of the sets; queries do
    not go through it (see plans.column)."""
    rows = docs
    for s in sets:
        rows = rows.withColumn(s, F.explode_outer(s))
    return rows


def semi_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The documents some rows belong to."""
    return docs.join(hits.select("doc_id"), "doc_id", "left_semi")


def deleted(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """Stored rows whose path is not staged any more."""
    return stored.join(staged.select("path"), "path", "left_anti")


def refreshed(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """Stored rows that are staged with an equal filetime, which is not null."""
    return stored.join(staged.select("path", "filetime").distinct(), ["path", "filetime"], "left_semi")


def unused(dimension: DataFrame, bridge: DataFrame, key: str) -> DataFrame:
    """Rows of a dictionary (id, ...) no bridge row refers to."""
    return dimension.join(bridge.select(F.col(key).alias("id")), "id", "left_anti")


def dictionary_encode(values: DataFrame, dimension: DataFrame, column: str) -> DataFrame:
    """Adds the id a value has in a dictionary (id, value)."""
    return values.join(dimension.select(F.col("id").alias(f"{column}_id"), column), column)

"""The document model every source is bound to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, TimestampNTZType

#: Moments are kept as UTC without zone, so that no session zone can move them.
DOC_SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("path", StringType()),
        StructField("title", StringType()),
        StructField("date", TimestampNTZType()),
        StructField("filetime", TimestampNTZType()),
        StructField("headings", StringType()),
        StructField("meta", StringType()),
        StructField("authors", ArrayType(StringType())),
        StructField("tags", ArrayType(StringType())),
        StructField("links", ArrayType(StringType())),
    ]
)
COLUMNS = DOC_SCHEMA.fieldNames()
SETS = ("authors", "tags", "links")


class SchemaError(TypeError):
    """Not a table of documents."""


def check_documents(df: DataFrame) -> DataFrame:
    """`df` itself if its columns are those of the model, in any order; SchemaError otherwise."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in DOC_SCHEMA}
    if have != want:
        wrong = sorted(k for k in {*have, *want} if have.get(k) != want.get(k))
        raise SchemaError(f"columns that are missing, not of the model or of another type: {wrong}")
    return df

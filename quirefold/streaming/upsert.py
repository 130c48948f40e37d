"""A folder of new Parquet batches of documents, kept in a store by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirefold.operators.store import DocumentStore, newest
from quirefold.schema import COLUMNS, DOC_SCHEMA


def watch(spark: SparkSession, folder: str, store: DocumentStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert every batch that arrives: newer filetimes win, paths that are not in a batch stay. A batch writes its own rows
    only. Its number is noted in the version, so a batch that is delivered again after a failure is left out."""

    def upsert(batch: DataFrame, number: int) -> None:
        store.update_some(newest(batch.select(*COLUMNS)).select(*COLUMNS), {"batch": number})

    stream = spark.readStream.schema(DOC_SCHEMA).parquet(folder).writeStream.foreachBatch(upsert)
    stream = stream.option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()

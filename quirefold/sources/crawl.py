"""Files of a folder as rows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, length bigint, filetime timestamp_ntz, content string"


def crawl(spark: SparkSession, root: str, ignore_hidden: bool = True) -> DataFrame:
    """FILES of all files below `root`, paths relative to it. With `ignore_hidden`, hidden files and all below hidden folders
    are left out; below a root whose own name is hidden, that is everything. Content is read only by plans that use it.

    Spark lists no file of no bytes (it has no header and would be no document) and none whose name starts with `_` or `.`;
    on file systems that are mounted (`file:`) tasks walk the folders for the latter and read them beside.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    if ignore_hidden and base.rsplit("/", 1)[-1].startswith("."):
        return spark.createDataFrame([], FILES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    out = files.select(
        F.substring(F.col("path"), len(base) + 2, 1 << 30).alias("path"),
        "length",
        F.date_trunc("second", F.col("modificationTime")).cast("timestamp_ntz").alias("filetime"),
        F.decode(F.col("content"), "UTF-8").alias("content"),
    )
    if base.startswith("file:"):
        out = out.unionByName(_odd_files(spark, unquote(urlsplit(base).path)))
    return out.where(~F.col("path").rlike(r"(^|/)\.")) if ignore_hidden else out


def _is_odd(path: str) -> bool:
    """Whether a step of a path starts with `_` or `.`."""
    return any(step[:1] in "_." for step in path.split("/"))


def _folders(root: str, enough: int) -> list[tuple[str, bool]]:
    """Folders below `root`, level by level until there are `enough`: (path, whether all below it is meant too)."""
    done, level = [], [""]
    while level and len(level) < enough:
        below = [e.path[len(root) + 1 :] for f in level for e in os.scandir(os.path.join(root, f)) if e.is_dir(follow_symlinks=False)]
        done += [(f, False) for f in level]
        level = below
    return done + [(f, True) for f in level]


def _odd_files(spark: SparkSession, root: str) -> DataFrame:
    """FILES of the files below a mounted root that have an odd step in their path, found and read by tasks, folder by folder."""

    def rows(path: str) -> pa.RecordBatch:
        full = os.path.join(root, path)
        moment = datetime.fromtimestamp(int(os.path.getmtime(full)), timezone.utc).replace(tzinfo=None)
        with open(full, "rb") as f:
            content = f.read()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([path]), pa.array([len(content)], pa.int64()), pa.array([moment], pa.timestamp("us")),
                pa.array([content.decode("utf-8", "replace")]),
            ],
            names=["path", "length", "filetime", "content"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, below in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for place, deeper, names in os.walk(os.path.join(root, folder)):
                    inside = os.path.relpath(place, root)
                    for name in names:
                        path = name if inside == "." else f"{inside}/{name}"
                        if _is_odd(path) and os.path.isfile(os.path.join(root, path)):
                            yield rows(path)
                    if not below:
                        deeper.clear()

    cores = spark.sparkContext.defaultParallelism
    listed = spark.createDataFrame(_folders(root, 4 * cores), "folder string, below boolean").repartition(cores)
    return listed.mapInArrow(work, FILES)


def table_files(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """The same columns from a table of texts and the paths they belong to."""
    paths = notes.select(F.col("id").alias("doc_id"), "path", F.date_trunc("second", "filetime").cast("timestamp_ntz").alias("filetime"))
    texts = docs.select("doc_id", F.col("text").alias("content"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("length"))
    return texts.join(paths, "doc_id").select("doc_id", "path", "length", "filetime", "content")

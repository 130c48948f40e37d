"""Session helpers: table access and the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` (a file or a folder of files) below `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


class NoSharedFolderError(RuntimeError):
    """A cluster without a folder that all its executors reach."""


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: `spark.checkpoint.dir`. Where that is unset, one on the default file system of the
    cluster, or with a local master (tests) a new local one; NoSharedFolderError if all that is left is a cluster's local disk."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    fs = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        own = f"{fs.getHomeDirectory()}/quirefold-{uuid.uuid4().hex}"
    elif context.master.startswith("local"):
        own = "file://" + tempfile.mkdtemp(prefix="quirefold-")
    else:
        raise NoSharedFolderError("set spark.checkpoint.dir to a folder that all executors reach")
    context.setCheckpointDir(own)
    return own


def spread(df: DataFrame, least_mb: int = 1) -> DataFrame:
    """`df` over all cores if there are less than `least_mb` of it for each: one small file would keep the rest idle while
    texts are worked on. Larger inputs are not moved. The size is that of the tables it reads; nothing runs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < cores * least_mb * 1_000_000 else df


_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table below the shared folder. release_scratch() or the end of the process removes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release_scratch() -> None:
    """Remove all intermediate tables of this process. Results that still read them must have been written before."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone at exit
            pass


atexit.register(release_scratch)

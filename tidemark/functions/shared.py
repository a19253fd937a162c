"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", folder)
    return f"{folder.rstrip('/')}/tidemark"


def new_path(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Rename what new_path() named and somebody wrote; where `to` is there already it stays, and path is left to remove_tables()."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target) and system.rename(source, target):
        _WRITTEN.append(to)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def spread(df: DataFrame) -> DataFrame:
    """df, which reads a table, over as many partitions as there are cores at least: a table in few files would keep most of them idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir (one of this machine's only where tasks run in this very machine and none is set)
    and read it back, which ends its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def dealt(df: DataFrame, name: str) -> DataFrame:
    """cut() for rows that are read many times and cost more than their bytes tell: over as many partitions as there are cores at least, however small they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    path = new_path(df.sparkSession, name)
    df.repartition(cores).write.option("compression", "zstd").parquet(path)  # a file a core, which Spark reads as a task where files are large
    return spread(df.sparkSession.read.schema(df.schema).parquet(path))


def discard(df: DataFrame) -> None:
    """Remove the table that cut() gave back as df, once nothing reads it any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        remove(df.sparkSession, folder)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go as soon as it has ended. Otherwise they stay until the driver collects its garbage, and those of all rounds of
    an iteration lie on the disks together. For queries whose frames are run once, such as those that end in cut()."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


def remove_tables(spark: SparkSession) -> int:
    """Remove what cut() has written, and return how many tables that were. Results not written elsewhere are lost with them."""
    removed = 0
    while _WRITTEN:
        removed += remove(spark, _WRITTEN.pop())
    return removed

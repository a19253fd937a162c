"""What the operators of this package share: tables, the shared folder, column appending."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset a session whose tasks run in this very
    machine gets one of its own; any other is refused, since executors elsewhere could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", folder)
    return folder.rstrip("/")


_WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def remove_tables(spark: SparkSession) -> int:
    """Remove what materialize() and new_path() have put into the shared folder, and return how many tables that were. Results
    that were not written elsewhere are lost with them."""
    removed = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow(), with batches bounded by bytes: rows are whole texts, and a task holds a few copies of a batch.

    A session that has set a bound of its own keeps it. A task gives the memory that Arrow keeps in stock back when it ends.
    """

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(conf.get(key)).removesuffix("b") == str(64 << 20):  # Spark's default
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def quoted(columns: list[str]) -> list[str]:
    """Names as select() takes them literally, dots and all."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def unused(df: DataFrame, name: str) -> str:
    """A name that df has no column of, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def append_columns(df: DataFrame, fields: dict[str, str], make: Callable[[], Callable[[pa.RecordBatch], list]], without: tuple[str, ...] = ()) -> DataFrame:
    """df without some of its columns and with others computed from Arrow batches. make() runs once per task and returns a function from
    a batch to one array per field. A column of df with the name of a field, in any case, is replaced."""
    replaced = {k.lower() for k in fields}
    kept = [c for c in df.columns if c.lower() not in replaced]
    safe = [f"__column {k}" if "." in c or "`" in c else c for k, c in enumerate(kept)]  # mapInArrow takes dots for fields
    base = df.select([F.col(q).alias(c) for q, c in zip(quoted(kept), safe)])
    added = T.StructType().fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items()))
    at = [k for k, c in enumerate(kept) if c not in without]
    schema = T.StructType([base.schema.fields[k] for k in at] + list(added.fields))
    names = [safe[k] for k in at] + list(fields)

    def run(batches):
        compute = make()
        for batch in batches:
            new = compute(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at), *(x if isinstance(x, pa.Array) else pa.array(x) for x in new)], names=names)

    done = map_arrow(base, run, schema)
    return done if safe == kept else done.toDF(*(kept[k] for k in at), *fields)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

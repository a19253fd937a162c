"""Reading and writing tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shared import exists, moved, new_path, shared_folder


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A headered CSV with declared types."""
    return spark.read.schema(schema).option("header", True).csv(path)


def export_csv(df: DataFrame, path: str, order_by: list[str]) -> None:
    """One flat, ordered, headered CSV file: for report-sized results only."""
    df.orderBy(*order_by).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet, replacing what is at path, and read it back. Rows are dealt by the partition
    columns first, so that a partition gets few files."""
    writer = df.repartition(*partition_by) if partition_by else df
    out = writer.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """A10: write df over the partitions of the table at path that df has rows of; the files of all others stay untouched. A partition that
    df has no row of is not emptied. df must not read from path."""
    writer = df.repartition(*partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def content_digest(df: DataFrame, *settings) -> str:
    """A digest of df's schema and rows, repeated ones too, in any order, and of the settings beside it."""
    rows = [F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)") for k in range(2)]
    sums = df.agg(F.count(F.lit(1)), *[F.sum(h) for h in rows]).first()
    return hashlib.sha256(repr((df.schema.simpleString(), *sums, settings)).encode()).hexdigest()[:32]


def fitted_once(df: DataFrame, name: str, fit: Callable[[DataFrame], PipelineModel], *settings) -> PipelineModel:
    """The model that fit(df) gives, fitted once for equal rows and settings: kept in the shared folder under the digest of both and
    loaded from there by later queries and sessions that share the folder. A model is in its place only when written whole.
    remove_tables() forgets the models of this session."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{content_digest(df, *settings)}"
    if not exists(spark, path):
        written = new_path(spark, name)
        save_model(fit(df), written)
        moved(spark, written, path)
    return load_model(path)

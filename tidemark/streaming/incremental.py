"""Incremental load and freshness."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shared import remove, shuffles_freed


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last by order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(base: DataFrame, updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """B1: base with restated records replaced; of several updates of a record the last by order counts."""
    return base.join(updates.select(key).distinct(), key, "left_anti").unionByName(latest(updates, key, order))


def upsert_children(base: DataFrame, updates: DataFrame, restated: DataFrame, key: str) -> DataFrame:
    """B1: child rows of restated records are replaced as a whole; a record restated without children loses them."""
    return base.join(restated.select(key).distinct(), key, "left_anti").unionByName(updates)


def scope(records: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """B2: records within inclusive bounds of years, either of them open."""
    out = records if start is None else records.where(F.col("year") >= start)
    return out if end is None else out.where(F.col("year") <= end)


def stream_upsert(spark: SparkSession, landing: str, schema: T.StructType | str, target: str, key: str, order: list[str], checkpoint: str, trigger: dict | None = None, buckets: int = 64, after: Callable[[DataFrame], None] | None = None, changed: Callable[[DataFrame, int], None] | None = None):
    """A file stream of deltas that keeps a table of the latest row per key under target, in buckets by a hash of the key.

    Every batch reads and writes the buckets that it touches, as a new generation beside the old one (merge_generation()), so
    that readers are not disturbed, and a batch that runs again after a failure writes the same generation again. A stream that
    starts anew, with another checkpoint, goes on above the generations that are there. changed(rows, generation) gets the rows
    that the batch has replaced (__sign -1) and those that it has put into the table (__sign 1), to carry what depends on the table forward: they lie on
    disk, each reading takes the columns that it asks for. after(table) is called then. current() reads the table.

    A batch and the rows held are dealt out and sorted once, by bucket and key; no table of whole rows is held in memory.
    """
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{target}/_schema")
    base = _base(spark, target, checkpoint)

    def apply(batch: DataFrame, number: int) -> None:
        session, generation = batch.sparkSession, base + number
        # a late delta must not undo a newer row
        with shuffles_freed(session):
            _, now = _merged(session, target, generation, batch, [key], buckets, lambda held, new: _newest(held, new, key, order, buckets, bool(changed)))
            gone = f"{target}/g{generation}/__bucket={buckets}"
            if changed:
                marked = T.StructType([*batch.schema.fields, T.StructField("__new", T.BooleanType())])
                lost = _read(session, [gone] if _names(session, gone) else [], batch.schema)
                came = _rows_of(session, target, now, marked).where("__new").drop("__new")
                changed(lost.withColumn("__sign", F.lit(-1)).unionByName(came.withColumn("__sign", F.lit(1))), generation)
            remove(session, gone)
        if after:
            after(current(session, target))

    reader = spark.readStream.schema(schema).parquet(landing)
    return reader.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merge_generation(spark: SparkSession, target: str, generation: int, rows: DataFrame, key: list[str], buckets: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Write combine(held rows, rows) for the buckets (a hash of key) that rows touch, as a generation of the table under target, and
    return these buckets before and after. combine must keep a row in the bucket of its key; what it gives back is dealt out by bucket unless it has been by dealt_out().

    target/_generations holds a list of the last two generations of every bucket, written last: a generation that is not in a
    complete list does not exist. Only those and the last two lists stay, so nothing grows with the number of batches.
    """
    before, now = _merged(spark, target, generation, rows, key, buckets, combine)
    return _rows_of(spark, target, before, rows.schema), _rows_of(spark, target, now, rows.schema)


def dealt_out(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """df with __bucket, a hash of key, and __share of it, by which it is dealt out: a bucket is the work of as many tasks as there are, and no task has many buckets."""
    hashed, tasks = F.xxhash64(*key), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = -(-4 * tasks // buckets)
    placed = df.withColumns({"__bucket": F.pmod(hashed, F.lit(buckets)).cast("int"), "__share": F.pmod(F.shiftrightunsigned(hashed, 20), F.lit(shares)).cast("int")})
    return placed.repartition("__bucket", "__share")


def _newest(held: DataFrame, new: DataFrame, key: str, order: list[str], buckets: int, replaced: bool) -> DataFrame:
    """The last row of each key by order, of equal ones the held one, with __new: whether it came; if asked for, the held rows that others replace are put into the bucket after the last."""
    both = dealt_out(held.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True))), [key], buckets)
    rank = F.row_number().over(Window.partitionBy("__bucket", "__share", key).orderBy(*[F.desc(c) for c in order], "__new"))
    ranked = both.withColumn("__rank", rank).where("__rank = 1 OR NOT __new" if replaced else "__rank = 1")
    return ranked.withColumn("__bucket", F.when(F.col("__rank") == 1, F.col("__bucket")).otherwise(buckets)).drop("__rank")


def _merged(spark: SparkSession, target: str, generation: int, rows: DataFrame, key: list[str], buckets: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[dict, dict]:
    """merge_generation(): the generations of the buckets touched, before and after."""
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    touched = sorted(r["b"] for r in rows.select(bucket.alias("b")).distinct().collect())  # at most `buckets`
    held = _generations(spark, target, before=generation)
    before = {b: held[b] for b in touched if b in held}
    folder = f"{target}/g{generation}"
    if touched:
        made = combine(_rows_of(spark, target, before, rows.schema), rows)
        if "__bucket" not in made.columns:
            made = dealt_out(made, key, buckets)
        made.drop("__share").write.mode("overwrite").option("compression", "zstd").partitionBy("__bucket").parquet(folder)
    filled = {int(name.split("=")[1]) for name in _names(spark, folder) if name.startswith("__bucket=")} if touched else set()
    now = held | {b: [(generation, b in filled), *held.get(b, [])[:1]] for b in touched}
    named = [(b, g, f) for b, kept in sorted(now.items()) for g, f in kept]
    spark.createDataFrame(named, "bucket int, generation long, filled boolean").coalesce(1).write.mode("overwrite").parquet(f"{target}/_generations/n{generation}")
    in_use = {g for _, g, _ in named}
    for b in touched:
        for g, _ in held.get(b, [])[1:]:
            remove(spark, f"{target}/g{g}/__bucket={b}")
    for g in {g for kept in held.values() for g, _ in kept} - in_use:
        remove(spark, f"{target}/g{g}")
    for n in [n for n in _lists(spark, target) if n < generation][:-1]:
        remove(spark, f"{target}/_generations/n{n}")
    return before, {b: now[b] for b in touched}


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, which need not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []


def _lists(spark: SparkSession, target: str) -> list[int]:
    """The generations of which there is a complete list (two or three), ascending."""
    found = [n for n in _names(spark, f"{target}/_generations") if n.startswith("n")]
    return sorted(int(n[1:]) for n in found if "_SUCCESS" in _names(spark, f"{target}/_generations/{n}"))


def _generations(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[tuple[int, bool]]]:
    """The generations of each bucket and whether they have rows, the newest first."""
    lists = [n for n in _lists(spark, target) if before is None or n < before]
    out: dict[int, list[tuple[int, bool]]] = {}
    if lists:
        rows = spark.read.schema("bucket int, generation long, filled boolean").parquet(f"{target}/_generations/n{lists[-1]}").collect()
        for r in sorted(rows, key=lambda r: -r["generation"]):  # two a bucket
            out.setdefault(r["bucket"], []).append((r["generation"], r["filled"]))
    return out


def _rows_of(spark: SparkSession, target: str, held: dict[int, list[tuple[int, bool]]], schema: T.StructType) -> DataFrame:
    return _read(spark, [f"{target}/g{kept[0][0]}/__bucket={b}" for b, kept in sorted(held.items()) if kept[0][1]], schema)


def _read(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _base(spark: SparkSession, target: str, checkpoint: str) -> int:
    """The generation of a stream's first batch: that of its first start if its checkpoint goes on, else one above those there."""
    place = f"{target}/_starts/{hashlib.sha256(checkpoint.encode()).hexdigest()}"
    if "offsets" in _names(spark, checkpoint) and "_SUCCESS" in _names(spark, place):
        return spark.read.schema("base long").parquet(place).first()["base"]
    base = max(_lists(spark, target), default=-1) + 1
    spark.createDataFrame([(base,)], "base long").coalesce(1).write.mode("overwrite").parquet(place)
    return base


def current(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    """The table that stream_upsert() or merge_generation() keeps; before the first batch it is empty. The schema is that of the stream if none is given."""
    schema = schema or spark.read.parquet(f"{target}/_schema").schema
    return _rows_of(spark, target, _generations(spark, target), schema)


def freshness(records: DataFrame, as_of: str, delta_days: int = 8) -> DataFrame:
    """Newest date, its age in days, and the feed that brings a table up to date: the recent delta if it
    reaches back far enough, else the current year's, else (no records) all."""
    gap = F.datediff(F.lit(as_of).cast("date"), F.col("newest"))
    feed = F.when(F.col("newest").isNull(), "all").when(gap <= delta_days, "modified").otherwise(F.lit(as_of[:4]))
    return records.agg(F.max("date").alias("newest")).select("newest", gap.cast("long").alias("gap_days"), feed.alias("feed"))


def release_state(local: DataFrame, upstream: DataFrame) -> DataFrame:
    """One row from the newest `release` of each side: unknown (none upstream), never (none here), current or behind."""
    both = local.agg(F.max("release").alias("local")).crossJoin(upstream.agg(F.max("release").alias("upstream")))  # one row each
    state = F.when(F.col("upstream").isNull(), "unknown").when(F.col("local").isNull(), "never").when(F.col("local") >= F.col("upstream"), "current").otherwise("behind")
    return both.withColumn("state", state)


def ingest_summary(scanned: DataFrame, records: DataFrame, assignments: DataFrame, affected: DataFrame) -> DataFrame:
    """Scanned, loaded and skipped records, those with a label, those with an affected row, entities, years."""
    ones = [
        scanned.agg(F.count(F.lit(1)).alias("scanned")),
        records.agg(F.count(F.lit(1)).alias("loaded"), F.min("year").alias("first_year"), F.max("year").alias("last_year")),
        assignments.agg(F.count_distinct("id").alias("labelled")),
        affected.agg(F.count_distinct("id").alias("with_item"), F.count_distinct("entity").alias("entities")),
    ]
    out = ones[0]
    for one in ones[1:]:
        out = out.crossJoin(one)  # one row each
    return out.withColumn("skipped", F.col("scanned") - F.col("loaded"))

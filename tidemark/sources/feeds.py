"""Raw feeds (A1-A5, A7): nested items to records, assignments and affected rows; the label catalogue."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_METRIC = "ARRAY<STRUCT<source STRING, type STRING, baseSeverity STRING, cvssData STRUCT<baseScore DOUBLE, baseSeverity STRING>>>"
_TEXT = "ARRAY<STRUCT<lang STRING, value STRING>>"
ITEM = (
    f"id STRING, published STRING, lastModified STRING, vulnStatus STRING, descriptions {_TEXT}, "
    f"metrics STRUCT<cvssMetricV31 {_METRIC}, cvssMetricV30 {_METRIC}, cvssMetricV2 {_METRIC}>, "
    f"weaknesses ARRAY<STRUCT<source STRING, type STRING, description {_TEXT}>>, "
    "configurations ARRAY<STRUCT<nodes ARRAY<STRUCT<cpeMatch ARRAY<STRUCT<vulnerable BOOLEAN, criteria STRING>>>>>>"
)
# fixed values: labels that say nothing, and the versions of scores from the newest on
GENERIC = ("NVD-CWE-Other", "NVD-CWE-noinfo")
VERSIONS = (("cvssMetricV31", "v31"), ("cvssMetricV30", "v30"), ("cvssMetricV2", "v2"))


def read_feed(spark: SparkSession, paths: list[str], layout: str = "jsonl", items: str = "cve_items") -> DataFrame:
    """A1: feed items with feed_order, the place of their file in paths. `jsonl` has an item a line and splits;
    `wrapped` is one object per file with an array of items, so a file is a task."""
    scheme = "^[a-z0-9]+:/+"  # listed and read files spell it differently
    file = F.regexp_replace("_metadata.file_path", scheme, "/").alias("__file")
    if layout == "wrapped":
        schema = T.StructType([T.StructField(items, T.ArrayType(T.StructType.fromDDL(ITEM)))])
        read = spark.read.schema(schema).option("multiLine", True).json(paths)
        rows = read.select(file, F.explode(items).alias("i")).select("__file", "i.*")
    elif layout == "jsonl":
        read = spark.read.schema(ITEM).json(paths)
        rows = read.select(file, "*")
    else:
        raise ValueError(f"no such layout: {layout}")
    bare = lambda path: re.sub(scheme, "/", path).rstrip("/")
    order = {bare(path): k for k, path in enumerate(paths)}

    def place(file: str) -> int:
        """Of the file itself, or of the folder in paths that it is in."""
        at = bare(unquote(file))
        while at not in order and "/" in at[1:]:
            at = at.rsplit("/", 1)[0]
        return order[at]

    files = spark.createDataFrame([(bare(f), place(f)) for f in read.inputFiles()], "__file string, feed_order int")
    return rows.join(files, "__file").drop("__file")


def pick_score(metrics: Column) -> Column:
    """A3: struct<score, version, severity> of the newest version that has entries: its first primary one, else its
    first. A version with entries is final even if they have no score."""
    out = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("severity"))
    for field, version in reversed(VERSIONS):
        entries = metrics[field]
        chosen = F.coalesce(F.get(F.filter(entries, lambda e: e["type"] == "Primary"), F.lit(0)), F.get(entries, F.lit(0)))
        here = F.struct(chosen["cvssData"]["baseScore"].alias("score"), F.lit(version).alias("version"), F.coalesce(chosen["cvssData"]["baseSeverity"], chosen["baseSeverity"]).alias("severity"))
        out = F.when(F.size(F.coalesce(entries, F.array())) > 0, here).otherwise(out)
    return out


def _described(items: DataFrame) -> DataFrame:
    """Items with text, their first English description; those without one, or with an empty one, are dropped."""
    text = F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    return items.withColumn("text", text).where(F.col("text") != "")


def flatten_records(items: DataFrame) -> DataFrame:
    """A2: record rows."""
    day = F.to_date(F.substring("published", 1, 10))
    return _described(items).withColumn("s", pick_score(F.col("metrics"))).select(
        "id",
        day.alias("date"),
        F.year(day).cast("long").alias("year"),
        F.to_timestamp("lastModified").alias("last_modified"),
        F.col("vulnStatus").alias("status"),
        "text",
        "s.score",
        "s.version",
        "s.severity",
        "feed_order",
    )


def explode_affected(items: DataFrame) -> DataFrame:
    """A4: (id, part, entity, item, version, feed_order) of vulnerable matches whose name has six parts or more; `_` reads as a
    space, empty or `*` entities and items are dropped. A name stated with several parts keeps the first."""
    nodes = _described(items).select("id", "feed_order", F.posexplode("configurations").alias("c", "conf")).select("id", "feed_order", "c", F.posexplode("conf.nodes").alias("n", "node"))
    matches = nodes.select("id", "feed_order", "c", "n", F.posexplode("node.cpeMatch").alias("m", "match")).where("match.vulnerable")
    p = F.split("match.criteria", ":")
    word = lambda k: F.trim(F.replace(F.get(p, F.lit(k)), F.lit("_"), F.lit(" ")))
    rows = matches.where(F.size(p) >= 6).select("id", "feed_order", F.struct("c", "n", "m").alias("at"), F.get(p, F.lit(2)).alias("part"), word(3).alias("entity"), word(4).alias("item"), F.get(p, F.lit(5)).alias("version"))
    rows = rows.where(~F.col("entity").isin("", "*") & ~F.col("item").isin("", "*"))
    return rows.groupBy("id", "entity", "item", "version", "feed_order").agg(F.min_by("part", "at").alias("part")).select("id", "part", "entity", "item", "version", "feed_order")


def explode_assignments(items: DataFrame) -> DataFrame:
    """A5: (id, label, source, type, generic, feed_order) of every English weakness value, each once."""
    w = _described(items).select("id", "feed_order", F.explode("weaknesses").alias("w")).select("id", "feed_order", "w.source", "w.type", F.explode("w.description").alias("d"))
    return w.where(F.col("d.lang") == "en").select("id", F.col("d.value").alias("label"), "source", "type", F.col("d.value").isin(*GENERIC).alias("generic"), "feed_order").distinct()


def latest_state(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of the last feed that states their record: a restated record's children replace the earlier ones as a
    whole. A record stated several times within that feed keeps all rows of it."""
    last = _described(items).groupBy("id").agg(F.max("feed_order").alias("feed_order"))
    return rows.join(last, ["id", "feed_order"], "left_semi")


def latest_records(records: DataFrame) -> DataFrame:
    """One row per record: of the last feed, and within it the last modified."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("feed_order"), F.desc("last_modified"), "text"))
    return records.withColumn("__place", place).where("__place = 1").drop("__place")


def read_label_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, description) from the Weakness, Category and View elements of an XML file that have an id and
    a name; markup inside a description is removed and white space collapsed, and none is empty."""
    found = None
    for tag in ("Weakness", "Category", "View"):
        one = spark.read.option("rowTag", tag).schema("_ID STRING, _Name STRING, Description STRING").xml(path).select(F.col("_ID").alias("id"), F.col("_Name").alias("name"), F.col("Description").alias("description"))
        found = one if found is None else found.unionByName(one)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("description", F.lit("")), "<[^>]+>", ""), r"\s+", " "))
    named = found.where((F.col("id") != "") & (F.col("name") != ""))
    return named.select(F.concat(F.lit("CWE-"), "id").alias("id"), "name", plain.alias("description"))

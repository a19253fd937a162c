"""Queries through feeds, files and streams: the star schema written in their form and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.shared import cut, discard, new_path, remove, shuffles_freed
from tidemark.operators import network as E
from tidemark.operators import trends as D
from tidemark.plans import trend_queries
from tidemark.plans.roles import AUTHORITY, PRIMARY, ROLE_SQL, Roles
from tidemark.sources import feeds, tables
from tidemark.streaming import incremental, maintained


def _q(f):
    return lambda spark, folder: f(Roles(spark, folder))


def _feed(x):
    """Every order as an item of a feed of JSON lines, written to the shared folder and read as A1 does."""
    text = lambda v: F.array(F.struct(F.lit("en").alias("lang"), v.alias("value")))
    asg = x.assignments().groupBy("id").agg(F.collect_list(F.struct("source", "type", text(F.col("label")).alias("description"))).alias("weaknesses"))
    name = F.concat_ws(":", F.lit("cpe"), F.lit("2.3"), F.lit("a"), F.concat(F.lit("s_"), F.col("entity").cast("string")), F.concat(F.lit("p"), F.col("item").cast("string")), F.col("version").cast("string"))
    match = F.struct((F.col("version") < 7).alias("vulnerable"), name.alias("criteria"))
    aff = x.affected().groupBy("id").agg(F.array(F.struct(F.array(F.struct(F.collect_list(match).alias("cpeMatch"))).alias("nodes"))).alias("configurations"))
    score = F.struct(F.col("score").alias("baseScore"), F.col("severity").alias("baseSeverity"))
    metrics = F.struct(F.array(F.struct(F.lit("s").alias("source"), F.lit("Primary").alias("type"), score.alias("cvssData"))).alias("cvssMetricV31"))
    rows = x.records().join(asg, "id", "left").join(aff, "id", "left").select(
        F.col("id").cast("string").alias("id"),
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("published"),
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("lastModified"),
        F.col("status").alias("vulnStatus"),
        text(F.concat(F.lit("order of customer "), F.col("customer").cast("string"))).alias("descriptions"),
        metrics.alias("metrics"),
        "weaknesses",
        "configurations",
    )
    path = new_path(x.spark, "feed")
    rows.select(F.to_json(F.struct("*"))).write.text(path)
    return feeds.read_feed(x.spark, [path])


def _csv(x):
    path = new_path(x.spark, "csv")
    tables.export_csv(D.year_totals(x.records()), path, ["year"])
    return tables.read_csv_table(x.spark, path, "year long, total long")


def _label_catalog(x):
    """The parts written as elements of three sorts with markup in their descriptions, some without a name, and read as a catalogue."""
    path = new_path(x.spark, "catalog")
    parts = x.table("part")
    text = F.concat(F.lit("<p>"), "p_type", F.lit("</p>\n   "), "p_brand", F.lit(" "))
    for k, tag in enumerate(("Weakness", "Category", "View")):
        some = parts.where(F.col("p_partkey") % 3 == k)
        name = F.when(F.col("p_partkey") % 10 != 0, F.col("p_name"))
        some.select(F.col("p_partkey").alias("_ID"), name.alias("_Name"), text.alias("Description")).write.option("rowTag", tag).option("rootTag", "Catalog").xml(f"{path}/{tag}")
    return feeds.read_label_catalog(x.spark, f"{path}/*")


def _stored(x):
    """Records stored by year; one year is read back."""
    return tables.materialize(x.records(), new_path(x.spark, "records"), ["year"]).where("year = 1997").select("id", "score", F.col("year").cast("long").alias("year"))


def _stored_buckets(x):
    """E1's buckets stored by year, one year of them from half the records, which is then made anew alone; only the latest five years are
    read, told by a join that prunes partitions while it runs."""
    aff, rec, canon = x.affected(), x.records(), x.canonical()
    path = new_path(x.spark, "buckets")
    tables.materialize(E.buckets(aff, rec.where("year <> 1997 OR id % 2 = 0"), canon), path, ["year"])
    tables.replace_partitions(E.buckets(aff, rec.where("year = 1997"), canon), path, ["year"])
    years = F.broadcast(D.latest_years(D.year_totals(rec), 5).select(F.col("year").cast("int").alias("year")))  # a row per year
    return x.spark.read.parquet(path).join(years, "year").select("entity", "item", F.col("year").cast("long").alias("year"), "label")


def _streamed(x):
    """Events as a stream of three deltas, upserted by user."""
    events = x.table("events").select("event_id", "ts", "user_id", "value")
    landing, target, state = (new_path(x.spark, n) for n in ("landing", "table", "state"))
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(landing)
        incremental.stream_upsert(x.spark, landing, events.schema, target, "user_id", ["ts", "event_id"], state, buckets=8).awaitTermination()
    return incremental.current(x.spark, target).select("user_id", "event_id", "value")


def _restated(x):
    """Orders with all their child rows, written once since both deltas and the stale versions read them, and what stale versions of half of them said."""
    asg = x.assignments().groupBy("id").agg(F.collect_list(F.struct("label", "source", "type", "generic")).alias("assignments"))
    aff = x.affected().groupBy("id").agg(F.collect_list(F.struct("entity", "item", "version")).alias("affected"))
    rows = cut(x.records().drop("customer").join(asg, "id", "left").join(aff, "id", "left").withColumn("modified", F.lit(1).cast("long")), "restated")
    less = lambda c: F.when(F.size(c) > 0, F.slice(c, 1, 1)).alias(c)
    stale = rows.where(F.col("id") % 2 == 0).select("id", "date", (F.col("year") - 1).alias("year"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("severity"), "status", less("assignments"), less("affected"), F.lit(0).cast("long").alias("modified"))
    return rows, stale.select(*rows.columns)


def _kept(x, *names):
    """All orders as a stream of two deltas: stale versions of a quarter and the rest as it is, then that quarter restated and stale versions
    of another quarter, which come too late."""
    with shuffles_freed(x.spark):
        rows, stale = _restated(x)
        landing, target, state = (new_path(x.spark, n) for n in ("landing", "kept", "state"))
        part, schema = F.col("id") % 4, rows.schema
        for k, delta in enumerate((stale.where(part == 0).unionByName(rows.where(part != 0)), rows.where(part == 0).unionByName(stale.where(part == 2)))):
            delta.write.mode("append").option("compression", "zstd").parquet(landing)
            if k:
                discard(rows)
            maintained.stream_tables(x.spark, landing, schema, target, ["modified"], state, authority=AUTHORITY, primary=PRIMARY, names=list(names), buckets=8).awaitTermination()
        remove(x.spark, landing)
    return maintained.Maintained(x.spark, target)


QUERIES = {
    "kept_assignments": _q(lambda x: _kept(x).children("assignments")),
    "kept_entity_trend": _q(lambda x: _kept(x, "entities").entity_year_trend()),
    "kept_item_trend": _q(lambda x: _kept(x, "items").item_year_trend()),
    "kept_label_trend": _q(lambda x: _kept(x, "labels", "coverage").label_year_trend()),
    "kept_severity_trend": _q(lambda x: _kept(x, "severities").severity_year_trend()),
    "kept_coverage": _q(lambda x: _kept(x, "coverage").coverage_by_year()),
    "kept_edges": _q(lambda x: _kept(x, "edges").edges()),
    "feed_records": _q(lambda x: feeds.flatten_records(_feed(x)).select("id", "date", "year", "status", "text", "score", "version", "severity")),
    "feed_affected": _q(lambda x: feeds.explode_affected(_feed(x)).select("id", "part", "entity", "item", "version")),
    "feed_assignments": _q(lambda x: feeds.explode_assignments(_feed(x)).select("id", "label", "source", "type", "generic")),
    "label_catalog": _q(_label_catalog),
    "csv_year_totals": _q(_csv),
    "stored_records": _q(_stored),
    "stored_buckets": _q(_stored_buckets),
    "stream_upsert": _q(_streamed),
}

ORACLE_SQL = {
    "kept_assignments": ROLE_SQL + " SELECT * FROM asg",
    "kept_entity_trend": trend_queries.ORACLE_SQL["entity_year_trend"],
    "kept_item_trend": trend_queries.ORACLE_SQL["item_year_trend"],
    "kept_label_trend": trend_queries.ORACLE_SQL["label_year_trend"],
    "kept_severity_trend": trend_queries.ORACLE_SQL["severity_year_trend"],
    "kept_coverage": trend_queries.ORACLE_SQL["coverage_by_year"],
    "kept_edges": ROLE_SQL + """, b AS (SELECT DISTINCT entity, item, year, label FROM aff JOIN rec USING (id) JOIN canon USING (id) WHERE NOT generic)
      SELECT x.label AS src, y.label AS dst, count(*) AS weight FROM b x JOIN b y ON x.entity = y.entity AND x.item = y.item AND x.year = y.year AND x.label < y.label GROUP BY ALL""",
    "feed_records": ROLE_SQL + " SELECT CAST(id AS VARCHAR) AS id, date, year, status, 'order of customer ' || customer AS text, score, 'v31' AS version, severity FROM rec",
    "feed_affected": ROLE_SQL + " SELECT DISTINCT CAST(id AS VARCHAR) AS id, 'a' AS part, 's ' || entity AS entity, 'p' || item AS item, CAST(version AS VARCHAR) AS version FROM aff WHERE version < 7",
    "feed_assignments": ROLE_SQL + " SELECT DISTINCT CAST(id AS VARCHAR) AS id, label, source, type, false AS generic FROM asg",
    "label_catalog": "SELECT 'CWE-' || p_partkey AS id, p_name AS name, p_type || ' ' || p_brand AS description FROM part WHERE p_partkey % 10 <> 0",
    "csv_year_totals": ROLE_SQL + " SELECT year, count(*) AS total FROM rec GROUP BY year",
    "stored_buckets": ROLE_SQL + " SELECT DISTINCT entity, item, year, label FROM aff JOIN rec USING (id) JOIN canon USING (id) WHERE NOT generic AND year IN (SELECT year FROM rec GROUP BY year ORDER BY year DESC LIMIT 5)",
    "stored_records": ROLE_SQL + " SELECT id, score, year FROM rec WHERE year = 1997",
    "stream_upsert": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1",
}

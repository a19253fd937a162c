"""Trends and edges that follow a stream of restated records without being counted anew (B1, B3 with D1-D6, E1, E2).

A delta's row is a record with all its child rows in arrays: (id, date, year, score, severity, status, assignments, affected,
and columns that order its versions). So one generation of the kept table holds all three tables, and a restated record
replaces its children as a whole. Each batch turns the versions that went and came into signed counts; adding them to the
counts kept is all it takes, and only the buckets of counts that a delta touches are read and written. Scores are counted by
value, so that least and greatest scores survive retractions. A label that enters or leaves a bucket of E1 adds or takes its
pairs with the other labels of that bucket alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shared import cut, discard
from tidemark.operators import trends as D
from tidemark.streaming.incremental import current, dealt_out, merge_generation, stream_upsert

#: Kept counts with their key; E1's buckets are stored by place, so that a bucket's labels lie together.
KEYS = {
    "entities": ["entity", "year", "score"],
    "items": ["entity", "item", "year", "score"],
    "labels": ["label", "year"],
    "severities": ["year", "severity"],
    "coverage": ["year", "has_item", "has_label"],
    "buckets": ["entity", "item", "year", "label"],
    "edges": ["src", "dst"],
}
PLACE = ["entity", "item", "year"]


def canonical(authority: str, primary: str) -> Column:
    """The canonical assignment of a record, chosen in its row as operators.labels.canonical_label() does; NULL without one."""

    def ranked(a: Column) -> Column:
        rank = F.when((a["source"] == authority) & (a["type"] == primary), 0).when(a["source"] == authority, 1).otherwise(2)
        return F.struct(rank.alias("rank"), a["type"].alias("type"), a["label"].alias("label"), a["generic"].alias("generic"))

    return F.array_min(F.transform("assignments", ranked))


def _each(versions: DataFrame, fields: list[str]) -> DataFrame:
    """Each version's distinct affected rows by fields."""
    found = F.array_distinct(F.transform("affected", lambda a: F.struct(*[a[f].alias(f) for f in fields])))
    return versions.withColumn("__a", F.explode(found)).select(*[c for c in versions.columns if c not in fields], "__a.*")


def signed(versions: DataFrame, name: str, authority: str, primary: str) -> DataFrame:
    """What versions (with __sign) add to the counts of that name: its key and n."""
    rows = versions
    if name in ("labels", "buckets"):
        rows = rows.withColumn("__best", canonical(authority, primary))
    if name == "entities":
        rows = _each(rows, ["entity"])
    elif name == "items":
        rows = _each(rows, ["entity", "item"])
    elif name == "labels":
        rows = rows.where(F.col("__best").isNotNull()).withColumn("label", F.col("__best.label"))
    elif name == "severities":
        rows = rows.withColumn("severity", F.coalesce("severity", F.lit(D.UNSCORED)))
    elif name == "coverage":
        named = F.coalesce(F.exists("assignments.generic", lambda generic: ~generic), F.lit(False))
        rows = rows.withColumns({"has_item": F.coalesce(F.size("affected.entity") > 0, F.lit(False)), "has_label": named})
    else:
        rows = _each(rows.where(~F.col("__best.generic")), ["entity", "item"]).withColumn("label", F.col("__best.label"))
    return rows.groupBy(*KEYS[name]).agg(F.sum("__sign").cast("long").alias("n")).where("n <> 0")


def _add(key: list[str], by: list[str], buckets: int):
    """Sums of held and new counts, both a row per key at most, where they are dealt out by bucket."""
    return lambda held, new: dealt_out(held.unionByName(new), by, buckets).groupBy("__bucket", "__share", *key).agg(F.sum("n").cast("long").alias("n")).where("n <> 0")


def edge_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Signed weights of pairs, from the labels (PLACE, label) of the same buckets of E1 before and after. Only pairs of a label
    that came or went are made, within the row of its bucket."""
    sides = before.withColumn("side", F.lit(0)).unionByName(now.withColumn("side", F.lit(1)))
    sets = sides.groupBy(*PLACE).agg(*[F.collect_set(F.when(F.col("side") == k, F.col("label"))).alias(name) for k, name in enumerate(("old", "new"))])
    moved = [
        sets.select(F.lit(sign).alias("sign"), F.col(mine).alias("all"), F.array_except(mine, other).alias("moved")).where(F.size("moved") > 0)
        for sign, mine, other in ((1, "new", "old"), (-1, "old", "new"))
    ]
    one = moved[0].unionByName(moved[1]).withColumn("label", F.explode("moved"))
    mates = F.filter("all", lambda x: (x != F.col("label")) & (~F.array_contains("moved", x) | (x > F.col("label"))))
    pairs = one.select("sign", "label", F.explode(mates).alias("mate"))
    pairs = pairs.select(F.least("label", "mate").alias("src"), F.greatest("label", "mate").alias("dst"), "sign")
    return pairs.groupBy("src", "dst").agg(F.sum("sign").cast("long").alias("n")).where("n <> 0")


def stream_tables(spark: SparkSession, landing: str, schema: T.StructType, target: str, order: list[str], checkpoint: str, *, authority: str, primary: str, names: list[str] | None = None, trigger: dict | None = None, buckets: int = 64):
    """Start the stream that keeps records with children (target/records) and the counts of `names` (all but given), under target.

    A batch that runs again after a failure finds the generations before it and writes the same ones. Repeated and late
    deltas change nothing; null years, scores and children count as values of their own, as in a group; a null array has no children.
    Ids are not null.
    """
    wanted = list(KEYS) if names is None else [n for n in KEYS if n in names or n == "buckets" and "edges" in names]
    versions_of = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def changed(versions: DataFrame, generation: int) -> None:
        session = versions.sparkSession

        def merge(name: str, counts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
            written = cut(counts, "signed")  # its buckets are asked for first
            out = merge_generation(session, f"{target}/{name}", generation, written, by, buckets, _add(KEYS[name], by, buckets))
            discard(written)
            return out

        for name in wanted:
            if name == "edges":
                continue
            before, now = merge(name, signed(versions, name, authority, primary), PLACE if name == "buckets" else KEYS[name])
            if name == "buckets" and "edges" in wanted:  # places without change give no pairs
                merge("edges", edge_changes(before.select(*PLACE, "label"), now.select(*PLACE, "label")), KEYS["edges"])

    return stream_upsert(spark, landing, versions_of, f"{target}/records", "id", order, checkpoint, trigger, buckets, changed=changed)


class Maintained:
    """What stream_tables() keeps, as the tables that the batch operators give; before the first batch all are empty."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target
        self.rows = current(spark, f"{target}/records")

    def records(self) -> DataFrame:
        return self.rows.drop("assignments", "affected")

    def children(self, name: str) -> DataFrame:
        """assignments or affected: a row per child."""
        return self.rows.select("id", F.explode(name).alias("c")).select("id", "c.*")

    def counts(self, name: str) -> DataFrame:
        """Kept counts: their key and n."""
        place = {f.name: f.dataType for f in self.rows.schema} | {f.name: f.dataType for c in ("assignments", "affected") for f in self.rows.schema[c].dataType.elementType}
        place |= {"has_item": T.BooleanType(), "has_label": T.BooleanType(), "src": place["label"], "dst": place["label"]}
        schema = T.StructType([T.StructField(k, place[k]) for k in KEYS[name]] + [T.StructField("n", T.LongType())])
        return current(self.spark, f"{self.target}/{name}", schema)

    def _scored(self, name: str) -> DataFrame:
        total = F.sum(F.col("score").cast("decimal(18,2)") * F.col("n").cast("decimal(18,0)")).cast("double")
        scored = F.coalesce(F.sum(F.when(F.col("score").isNotNull(), F.col("n"))), F.lit(0)).cast("long")
        keys = [k for k in KEYS[name] if k != "score"]
        counts = self.counts(name)
        if name == "items":  # about as many groups as rows: these are dealt out as they are, and once for the years of an item
            counts = counts.repartition("entity", "item")
        return counts.groupBy(*keys).agg(F.sum("n").alias("n"), total.alias("total"), scored.alias("scored"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))

    def entity_year_trend(self) -> DataFrame:
        return D.entity_trend_of(self._scored("entities"))

    def item_year_trend(self) -> DataFrame:
        return D.item_trend_of(self._scored("items"))

    def label_year_trend(self) -> DataFrame:
        totals = self.counts("coverage").groupBy("year").agg(F.sum("n").alias("total"))
        return D.label_trend_of(self.counts("labels"), totals)

    def severity_year_trend(self) -> DataFrame:
        return D.severity_trend_of(self.counts("severities"))

    def coverage_by_year(self) -> DataFrame:
        some = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0)).cast("long")
        return D.coverage_of(self.counts("coverage").groupBy("year").agg(F.sum("n").alias("total"), some("has_item").alias("with_item"), some("has_label").alias("with_label")))

    def edges(self) -> DataFrame:
        """E2."""
        return self.counts("edges").withColumnRenamed("n", "weight")

"""The star schema in the roles that the operators know, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import spread
from tidemark.operators.labels import canonical_label
from tidemark.sources.tables import read_table

AUTHORITY, PRIMARY, GENERIC = "N", "O", "PROMO"
#: Numbers of labels, in and out of the families.
WEAKNESSES = [20, 22, 74, 77, 78, 79, 80, 89, 90, 94, 98, 113, 119, 120, 121, 122, 125, 129, 134, 190, 200, 287, 352, 362, 401, 415, 416, 434, 476, 611, 787, 824, 843, 862, 908, 918, 1321]


class Roles:
    """records: orders; assignments: line items with their part's brand and type; affected: line items."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def records(self) -> DataFrame:
        severity = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
        day = F.to_date("o_orderdate")
        return self.table("orders").select(F.col("o_orderkey").alias("id"), day.alias("date"), F.year(day).cast("long").alias("year"), F.col("o_totalprice").alias("score"), severity.alias("severity"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))

    def assignments(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit("/"), "p_type").alias("label"), (F.col("p_type") == GENERIC).alias("generic"))
        return self.table("lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("id"), "label", F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("type"), "generic")

    def affected(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("version"))

    def canonical(self) -> DataFrame:
        return canonical_label(self.assignments(), AUTHORITY, PRIMARY)

    def weaknesses(self) -> DataFrame:
        """Canonical labels of another sort: line items with labels of the families, by their part."""
        number = F.element_at(F.array(*map(F.lit, WEAKNESSES)), (F.col("l_partkey") % len(WEAKNESSES) + 1).cast("int")).cast("string")
        label = F.when(F.col("l_partkey") % 37 == 0, "NVD-CWE-noinfo").when(F.col("l_partkey") % 41 == 0, "NVD-CWE-Other").otherwise(F.concat(F.lit("CWE-"), number))
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("id"), label.alias("label"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("type"))
        return canonical_label(rows.withColumn("generic", F.col("label").startswith("NVD")), AUTHORITY, PRIMARY)

    def catalog(self) -> DataFrame:
        """Names of labels: those of the parts with their numbers."""
        return self.table("part").select(F.concat(F.lit("CWE-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))

    def archetypes(self) -> DataFrame:
        """A given archetype of every supplier, by nation."""
        return self.table("supplier").select(F.col("s_suppkey").alias("entity"), F.concat(F.lit("G"), (F.col("s_nationkey") % 4).cast("string")).alias("archetype"))

    def documents(self) -> DataFrame:
        """Documents with groups (source), label (quality, 'generic' where toxic) and no label for most."""
        labels = self.table("labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"), (F.col("toxic") == 1).alias("generic"))
        return spread(self.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), "text", "lang")).join(labels.withColumnRenamed("doc_id", "id"), "id", "left")


ROLE_SQL = f"""
WITH rec AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, year(o_orderdate) AS year, o_totalprice AS score,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS severity, o_orderstatus AS status, o_custkey AS customer FROM orders
), asg AS (
  SELECT l_orderkey AS id, p_brand || '/' || p_type AS label, l_returnflag AS source, l_linestatus AS type, p_type = '{GENERIC}' AS generic
  FROM lineitem JOIN part ON l_partkey = p_partkey
), aff AS (
  SELECT l_orderkey AS id, l_suppkey AS entity, l_partkey AS item, l_linenumber AS version FROM lineitem
), canon AS (
  SELECT id, label, generic FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY
    CASE WHEN source = '{AUTHORITY}' AND type = '{PRIMARY}' THEN 0 WHEN source = '{AUTHORITY}' THEN 1 ELSE 2 END, type, label, generic) AS rn FROM asg) WHERE rn = 1
), docs AS (
  SELECT d.doc_id AS id, source AS grp, text, lang, 'q' || quality AS label, toxic = 1 AS generic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


WEAKNESS_SQL = f"""{ROLE_SQL}, wk AS (
  SELECT id, label, label LIKE 'NVD%' AS generic FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY
    CASE WHEN source = '{AUTHORITY}' AND type = '{PRIMARY}' THEN 0 WHEN source = '{AUTHORITY}' THEN 1 ELSE 2 END, type, label) AS rn FROM (
    SELECT l_orderkey AS id, CASE WHEN l_partkey % 37 = 0 THEN 'NVD-CWE-noinfo' WHEN l_partkey % 41 = 0 THEN 'NVD-CWE-Other' ELSE 'CWE-' || {WEAKNESSES}[l_partkey % {len(WEAKNESSES)} + 1] END AS label,
      l_returnflag AS source, l_linestatus AS type FROM lineitem)) WHERE rn = 1
), pe AS (SELECT DISTINCT id, entity FROM aff)"""


def r(x: str, digits: int) -> str:
    """Half-up rounding in SQL, as functions.stats.rounded."""
    return f"(floor(({x}) * {10**digits} + 0.5) / {10**digits}.0)"


def money(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"

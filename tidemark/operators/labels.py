"""Labels of records.

Assignments are (id, label, source, type, generic): a record may have many. Canonical labels are
(id, label, generic), one per labelled record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: labels whose names the catalogue lacks
SPECIAL_NAMES = {"NVD-CWE-Other": "Other / not mapped to a specific weakness", "NVD-CWE-noinfo": "No weakness information provided"}
# fixed values: families of labels by which an entity is characterised
LABEL_FAMILIES = {
    "memory safety": ["CWE-119", "CWE-120", "CWE-121", "CWE-122", "CWE-125", "CWE-129", "CWE-134", "CWE-190", "CWE-401", "CWE-415", "CWE-416", "CWE-476", "CWE-787", "CWE-824", "CWE-843", "CWE-908"],
    "web and injection": ["CWE-22", "CWE-74", "CWE-77", "CWE-78", "CWE-79", "CWE-80", "CWE-89", "CWE-90", "CWE-94", "CWE-98", "CWE-113", "CWE-352", "CWE-434", "CWE-611", "CWE-918", "CWE-1321"],
}


def canonical_label(assignments: DataFrame, authority: str, primary: str) -> DataFrame:
    """One label per record: the authority's primary one, else any of the authority's, else any.

    Ties go to the smaller type, then label. min_by over a struct aggregates before the shuffle.
    """
    rank = F.when((F.col("source") == authority) & (F.col("type") == primary), 0).when(F.col("source") == authority, 1).otherwise(2)
    best = F.min_by(F.struct("label", "generic"), F.struct(rank.alias("rank"), "type", "label", "generic")).alias("best")
    return assignments.groupBy("id").agg(best).select("id", "best.label", "best.generic")


def assignments_flagged(assignments: DataFrame, canonical: DataFrame) -> DataFrame:
    """All assignments with is_canonical: the label is the record's canonical one, whichever source names it."""
    best = canonical.select("id", F.col("label").alias("__best"))
    return assignments.join(best, "id", "left").withColumn("is_canonical", F.coalesce(F.col("label") == F.col("__best"), F.lit(False))).drop("__best")


def top_k_labels(canonical: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent non-generic canonical labels: label, n, rank; ties go to the smaller label."""
    counts = canonical.where(~F.col("generic")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(k)


def with_top_label(canonical: DataFrame, k: int = 20, other: str = "Other") -> DataFrame:
    """canonical with top_label: the label if it is among the k most frequent, else `other`; NULL if generic."""
    top = top_k_labels(canonical, k).select("label", F.lit(True).alias("__top"))
    joined = canonical.join(F.broadcast(top), "label", "left")  # k rows
    return joined.withColumn("top_label", F.when(F.col("generic"), None).when(F.col("__top"), F.col("label")).otherwise(other)).drop("__top").select("id", "label", "generic", "top_label")


def label_names(df: DataFrame, catalog: DataFrame, label: str = "label") -> DataFrame:
    """df with name, description and display (`label (name)`, or the label alone where it is unknown)."""
    special = F.create_map(*[F.lit(x) for pair in SPECIAL_NAMES.items() for x in pair])
    names = catalog.select(F.col("id").alias(label), F.col("name").alias("__name"), "description").dropDuplicates([label])
    out = df.join(names, label, "left").withColumn("name", F.coalesce(F.try_element_at(special, F.col(label)), F.col("__name"))).drop("__name")
    return out.withColumn("display", F.when(F.col("name").isNull(), F.col(label)).otherwise(F.concat(label, F.lit(" ("), "name", F.lit(")"))))


def label_family(df: DataFrame, families: dict[str, list[str]] | None = None, label: str = "label") -> DataFrame:
    """df with family, the first of the families (LABEL_FAMILIES) that lists the label."""
    families = families or LABEL_FAMILIES
    family = F.lit(None).cast("string")
    for name, members in reversed(families.items()):
        family = F.when(F.col(label).isin(*members), name).otherwise(family)
    return df.withColumn("family", family)

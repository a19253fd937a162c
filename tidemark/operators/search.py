"""Search and lookup of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_id(x: Column, prefix: str = "CVE", year_digits: int = 4, least_digits: int = 4) -> Column:
    """C3f: `PREFIX-year-number` from loose spellings, else NULL."""
    found = F.regexp_extract(F.trim(F.upper(x)), rf"^(?:{prefix}-)?(\d{{{year_digits}}}-\d{{{least_digits},}})$", 1)
    return F.when(found != "", F.concat(F.lit(f"{prefix}-"), found))


def has_words(text: Column, words: str) -> Column:
    """C3e: every word of the query occurs in the text, in any (ASCII) case; no character is special."""
    out = F.lit(True)
    for word in words.split():
        out = out & F.lower(text).contains(word.lower())
    return out


def search(records: DataFrame, *, affected: DataFrame | None = None, entities: list | None = None, canonical: DataFrame | None = None, labels: list[str] | None = None, first_year: int | None = None, last_year: int | None = None, missing_entity: bool = False, words: str | None = None, text: str = "text") -> DataFrame:
    """Records that meet every given condition: any of the entities, a canonical label among labels, a
    range of years, no affected row at all, all words in the text."""
    out = records
    if first_year is not None:
        out = out.where(F.col("year") >= first_year)
    if last_year is not None:
        out = out.where(F.col("year") <= last_year)
    if words:
        out = out.where(has_words(F.col(text), words))
    if entities:
        out = out.join(affected.where(F.col("entity").isin(entities)).select("id"), "id", "left_semi")
    if labels:
        out = out.join(canonical.where(F.col("label").isin(labels)).select("id"), "id", "left_semi")
    if missing_entity:
        out = out.join(affected.select("id"), "id", "left_anti")
    return out


def page(found: DataFrame, order: str = "newest", limit: int = 200) -> DataFrame:
    """C3g: one page, newest first or by severity (highest score first, unscored last); the id settles ties."""
    keys = {"newest": [F.desc("date"), F.desc("id")], "severity": [F.desc_nulls_last("score"), F.desc("date"), F.desc("id")]}[order]
    return found.orderBy(*keys).limit(limit)


def page_with_total(found: DataFrame, order: str = "newest", limit: int = 200) -> DataFrame:
    """C3h: the page, with the number of all matches beside it."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return page(found, order, limit).crossJoin(F.broadcast(total))  # one row


def enriched(rows: DataFrame, canonical: DataFrame, affected: DataFrame, unscored: str = "UNSCORED") -> DataFrame:
    """C3i: a page with the canonical label, a severity in words, and the distinct entities joined to a string."""
    ids = rows.select("id").distinct()
    label = canonical.join(ids, "id", "left_semi").select("id", "label")
    names = affected.join(ids, "id", "left_semi").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("entity")), lambda e: e.cast("string")), ", ").alias("entities"))
    return rows.withColumn("severity", F.coalesce("severity", F.lit(unscored))).join(label, "id", "left").join(names, "id", "left")


def record_detail(records: DataFrame, assignments: DataFrame, affected: DataFrame, canonical: DataFrame) -> DataFrame:
    """C4: nested records: all assignments by type and label, all products by entity, item and version."""
    labels = assignments.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("type", "label", "source", "generic"))).alias("assignments"))
    products = affected.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("entity", "item", "version"))).alias("products"))
    return records.join(labels, "id", "left").join(products, "id", "left").join(canonical.select("id", F.col("label").alias("canonical")), "id", "left")


def exclude_status(records: DataFrame, bad: str) -> DataFrame:
    """Records with another status; those without one go too."""
    return records.where(F.col("status") != bad)


def clip(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of an inclusive range of years."""
    return df.where(F.col("year").between(first, last))


def entity_groups(affected: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Per record and archetype its entities, for records with profiled entities."""
    pairs = affected.select("id", "entity").distinct().join(archetypes.select("entity", "archetype"), "entity")
    return pairs.groupBy("id", "archetype").agg(F.sort_array(F.collect_set("entity")).alias("entities"))

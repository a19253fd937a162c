"""Entity extraction and fact tables for free-text questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import percent
from tidemark.operators import trends as D
from tidemark.operators.labels import label_family
from tidemark.operators.search import entity_groups, record_detail


def entity_dictionary(affected: DataFrame, min_records: int = 20, min_chars: int = 3) -> DataFrame:
    """Entities with enough distinct records and a long enough name."""
    counts = affected.select("id", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= min_records) & (F.char_length(F.col("entity").cast("string")) >= min_chars))


# fixed values: how ids of records and labels are written in questions, as regular expressions of their parts
RECORD_PATTERN, LABEL_PATTERN, YEAR_PATTERN, WORD_PATTERN = r"\bcve[-\s]?(\d{4})[-\s](\d{4,})\b", r"cwe[-\s]?(\d+)", r"\b(19[89]\d|20[0-4]\d)\b", r"[a-z0-9][a-z0-9._-]*"


def extract_entities(texts: DataFrame, dictionary: DataFrame, *, id: str = "id", text: str = "text", most: int = 3) -> DataFrame:
    """Per text the first `most` distinct record ids (cut out before the rest is looked at), dictionary entities (by word, then by pairs of
    words joined by a space or `_`), label ids and years 1980-2049, each in order of appearance. Ids however written come as CVE-year-number and
    CWE-number. A null text has none; ids are unique."""
    low = texts.select(F.col(id).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    rest = F.regexp_replace("t", RECORD_PATTERN, " ")
    first = lambda found: F.slice(F.array_distinct(found), 1, most)
    found = lambda x, pattern, part: F.regexp_extract_all(x, F.lit(pattern), F.lit(part))
    parts = low.select(
        "id",
        first(F.zip_with(found("t", RECORD_PATTERN, 1), found("t", RECORD_PATTERN, 2), lambda y, n: F.concat(F.lit("CVE-"), y, F.lit("-"), n))).alias("records"),
        first(F.transform(found(rest, LABEL_PATTERN, 1), lambda n: F.concat(F.lit("CWE-"), n))).alias("labels"),
        first(found(rest, YEAR_PATTERN, 1)).alias("years"),
        found(rest, WORD_PATTERN, 0).alias("w"),
    )
    pairs = lambda joint: F.when(F.size("w") >= 2, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("at"), F.concat(F.get("w", i), F.lit(joint), F.get("w", i + 1)).alias("entity")))).otherwise(F.array())
    words = F.transform("w", lambda w, i: F.struct(F.lit(0).alias("kind"), i.alias("at"), w.alias("entity")))
    seen = parts.select("id", F.explode(F.concat(words, pairs(" "), pairs("_"))).alias("c")).select("id", "c.*")
    known = dictionary.select(F.lower(F.col("entity").cast("string")).alias("entity")).distinct()
    hits = seen.join(known, "entity").groupBy("id", "entity").agg(F.min(F.struct("kind", "at")).alias("at"))
    hits = hits.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity"))), lambda h: h["entity"]), 1, most).alias("entities"))
    return parts.drop("w").join(hits, "id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def _top(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value)).cast("long")).where(F.col("place") <= n)


def entity_facts(records: DataFrame, affected: DataFrame, canonical: DataFrame, n_labels: int = 10) -> DataFrame:
    """For every entity its records and its top labels with their share of those labels and of all records."""
    pairs = affected.select("id", "entity").distinct()
    totals = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("total"))
    top = _top(pairs.join(canonical.where(~F.col("generic")).select("id", "label"), "id"), "entity", "label", n_labels)
    out = top.join(totals, "entity").withColumn("top_sum", F.sum("n").over(Window.partitionBy("entity")))
    return out.select("entity", "total", "place", "label", "n", percent(F.col("n"), F.col("top_sum")).alias("pct_of_top"), percent(F.col("n"), F.col("total")).alias("pct_of_all"))


def entity_family_facts(facts: DataFrame, families: dict[str, list[str]] | None = None) -> DataFrame:
    """Per entity and family the part of its top labels, in percent."""
    return label_family(facts, families).where(F.col("family").isNotNull()).groupBy("entity", "family").agg(F.sum("pct_of_top").alias("pct_of_top"))


def entity_items(affected: DataFrame, n: int = 5) -> DataFrame:
    """The items of an entity with the most records."""
    return _top(affected.select("id", "entity", "item").distinct(), "entity", "item", n)


def _last_years(df: DataFrame, key: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("year"))).cast("long")
    return df.withColumn("place", place).where(F.col("place") <= n)


def entity_years(records: DataFrame, affected: DataFrame, n: int = 8) -> DataFrame:
    """An entity's records in each of its last n years that have any; place 1 is the newest."""
    pairs = affected.select("id", "entity").distinct().join(records.select("id", "year"), "id")
    return _last_years(pairs.groupBy("entity", "year").agg(F.count(F.lit(1)).alias("n")), "entity", n)


def label_years(trend: DataFrame, n: int = 8) -> DataFrame:
    """I4: of D4's rows those of each label's last n years; place 1 is the newest."""
    return _last_years(trend.select("label", "year", "n", "pct_of_year", "yoy_pct"), "label", n)


def label_facts(records: DataFrame, affected: DataFrame, canonical: DataFrame, n: int = 8) -> DataFrame:
    """I4: for every label its records and its top entities."""
    totals = canonical.groupBy("label").agg(F.count(F.lit(1)).alias("total"))
    top = _top(affected.select("id", "entity").distinct().join(canonical.select("id", "label"), "id"), "label", "entity", n)
    return top.join(totals, "label").select("label", "total", "place", "entity", "n")


def year_facts(records: DataFrame, affected: DataFrame, canonical: DataFrame, assignments: DataFrame, n: int = 8) -> DataFrame:
    """For every year a long table (year, section, place, key, value): published, with affected data, top labels and entities."""
    dated = records.select("id", "year")
    cover = D.coverage_by_year(records, affected, assignments)
    row = lambda df, section, place, key, value: df.select("year", F.lit(section).alias("section"), place.cast("long").alias("place"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    one = F.lit(1)
    out = row(cover, "published", one, F.lit("records"), F.col("total")).unionByName(row(cover, "affected_pct", one, F.lit("pct"), F.col("item_pct")))
    labels = _top(dated.join(canonical.where(~F.col("generic")).select("id", "label"), "id"), "year", "label", n)
    entities = _top(dated.join(affected.select("id", "entity").distinct(), "id"), "year", "entity", n)
    return out.unionByName(row(labels, "label", F.col("place"), F.col("label"), F.col("n"))).unionByName(row(entities, "entity", F.col("place"), F.col("entity"), F.col("n")))


def record_facts(records: DataFrame, affected: DataFrame, text: str = "text", chars: int = 1500) -> DataFrame:
    """Per record its distinct items (of one entity each) and entities, and its text cut at a word after `chars` characters."""
    counts = affected.groupBy("id").agg(F.count_distinct(F.struct("entity", "item")).alias("items"), F.count_distinct("entity").alias("entities"))
    short = F.when(F.char_length(text) <= chars, F.col(text)).otherwise(F.regexp_replace(F.substring(text, 1, chars), r"\s\S*\z", ""))
    return records.select("id", short.alias("excerpt")).join(counts, "id", "left").fillna(0, ["items", "entities"])


def record_briefing(records: DataFrame, assignments: DataFrame, affected: DataFrame, canonical: DataFrame, archetypes: DataFrame, text: str = "text", chars: int = 1500) -> DataFrame:
    """C4's nested records with record_facts() and, as groups, C7's (archetype, entities) of the profiled entities."""
    groups = entity_groups(affected, archetypes).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("archetype", "entities"))).alias("groups"))
    return record_detail(records, assignments, affected, canonical).join(record_facts(records, affected, text, chars), "id").join(groups, "id", "left")


def overview_facts(records: DataFrame, affected: DataFrame, canonical: DataFrame, assignments: DataFrame, years: int = 10) -> DataFrame:
    """One long table (section, place, key, value, pct) of the whole collection: span, last years, coverage, top entities of
    the latest year and of all, and the latest year's top labels and severities with their percent of the year."""

    def ranked(df: DataFrame, section: str, key: str, value: str, n: int, *order, pct: str | None = None) -> DataFrame:
        first = df.orderBy(*order).limit(n)
        place = F.row_number().over(Window.orderBy(*order)).cast("long")  # n rows
        share = F.col(pct) if pct else F.lit(None).cast("double")
        return first.select(F.lit(section).alias("section"), place.alias("place"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), share.alias("pct"))

    def latest(df: DataFrame) -> DataFrame:
        return df.join(records.agg(F.max("year").alias("year")), "year", "left_semi")

    span = records.agg(F.min("year").alias("first"), F.max("year").alias("last")).unpivot([], ["first", "last"], "key", "value")
    totals, cover = D.year_totals(records), D.coverage_by_year(records, affected, assignments)
    pairs = affected.select("id", "entity").distinct()
    count = lambda df: df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        ranked(span, "span", "key", "value", 2, "key"),
        ranked(totals, "year", "year", "total", years, F.desc("year")),
        ranked(cover, "coverage", "year", "item_pct", 6, F.desc("year")),
        ranked(count(pairs.join(latest(records).select("id"), "id", "left_semi")), "entity_latest", "entity", "n", 10, F.desc("n"), "entity"),
        ranked(count(pairs), "entity", "entity", "n", 10, F.desc("n"), "entity"),
        ranked(latest(D.label_year_trend(records, canonical)), "label_latest", "label", "n", 10, F.desc("n"), "label", pct="pct_of_year"),
        ranked(latest(D.severity_year_trend(records)), "severity_latest", "severity", "n", 10, F.desc("n"), "severity", pct="pct_of_year"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

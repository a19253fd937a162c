"""Yearly tables over records.

records are (id, date, year, score, severity, status), affected (id, entity, item, version), canonical (id, label, generic).
A record weighs once per entity or item: duplicates go before anything is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import exact_sum, percent, rounded

# fixed values: severities from worst to none
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE", "UNSCORED")
UNSCORED = "UNSCORED"


def dedupe_pairs(affected: DataFrame, keys: list[str]) -> DataFrame:
    """Each (keys, id) once."""
    return affected.select("id", *keys).distinct()


def _scored(records: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    joined = dedupe_pairs(affected, keys).join(records.select("id", "year", "score"), "id")
    return joined.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("n"), exact_sum("score").alias("total"), F.count("score").alias("scored"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def entity_year_trend(records: DataFrame, affected: DataFrame) -> DataFrame:
    """Per entity and year count, score statistics, the average pooled over this and the two present years
    before, and growth over the last present year in percent."""
    return entity_trend_of(_scored(records, affected, ["entity"]))


def entity_trend_of(scored: DataFrame) -> DataFrame:
    """D1 from (entity, year, n, total, scored, min_score, max_score)."""
    by_year = Window.partitionBy("entity").orderBy("year")
    frame = by_year.rowsBetween(-2, 0)
    before = F.lag("n").over(by_year)
    return scored.select(
        "entity",
        "year",
        "n",
        rounded(F.col("total") / F.nullif(F.col("scored"), F.lit(0)), 2).alias("avg_score"),
        "min_score",
        "max_score",
        rounded(F.sum(F.col("total").cast("decimal(18,2)")).over(frame).cast("double") / F.nullif(F.sum("scored").over(frame), F.lit(0)), 2).alias("rolling_avg_score"),
        percent(F.col("n") - before, before).alias("yoy_pct"),
    )


def rank_by_year(trend: DataFrame, name: str = "rank_in_year") -> DataFrame:
    """Rank by count within the year; ties share. Only a row per year and distinct count is sorted, never the rows of a year."""
    per_count = trend.groupBy("year", "n").agg(F.count(F.lit(1)).alias("__rows"))
    above = F.sum("__rows").over(Window.partitionBy("year").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = per_count.select("year", "n", (1 + F.coalesce(above, F.lit(0))).cast("long").alias(name))
    return trend.join(ranks, ["year", "n"]).select(*trend.columns, name)


def item_year_trend(records: DataFrame, affected: DataFrame) -> DataFrame:
    """D3: per entity, item and year count, average score and rank in the year."""
    return item_trend_of(_scored(records, affected, ["entity", "item"]))


def item_trend_of(trend: DataFrame) -> DataFrame:
    """D3 from (entity, item, year, n, total, scored)."""
    return rank_by_year(trend.select("entity", "item", "year", "n", rounded(F.col("total") / F.nullif(F.col("scored"), F.lit(0)), 2).alias("avg_score")))


def year_totals(records: DataFrame) -> DataFrame:
    """Records per year."""
    return records.groupBy("year").agg(F.count(F.lit(1)).alias("total"))


def label_year_trend(records: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per canonical label and year count, percent of all records of the year (labelled or not), growth in percent."""
    counts = canonical.join(records.select("id", "year"), "id").groupBy("label", "year").agg(F.count(F.lit(1)).alias("n"))
    return label_trend_of(counts, year_totals(records))


def label_trend_of(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """D4 from (label, year, n) and (year, total)."""
    before = F.lag("n").over(Window.partitionBy("label").orderBy("year"))
    return counts.join(totals, "year").select("label", "year", "n", percent(F.col("n"), F.col("total"), 2).alias("pct_of_year"), percent(F.col("n") - before, before).alias("yoy_pct"))


def severity_year_trend(records: DataFrame) -> DataFrame:
    """Mix of severities per year."""
    counts = records.groupBy("year", F.coalesce("severity", F.lit(UNSCORED)).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return severity_trend_of(counts)


def severity_trend_of(counts: DataFrame) -> DataFrame:
    """D5 from (year, severity, n)."""
    return counts.withColumn("pct_of_year", percent(F.col("n"), F.sum("n").over(Window.partitionBy("year")), 2))


def coverage_by_year(records: DataFrame, affected: DataFrame, assignments: DataFrame) -> DataFrame:
    """Records per year, those with an affected row and those with a non-generic assignment, and their percent.

    Flags come from distinct ids, so no join fans out.
    """
    has_item = affected.select("id").distinct().withColumn("has_item", F.lit(1))
    has_label = assignments.where(~F.col("generic")).select("id").distinct().withColumn("has_label", F.lit(1))
    flagged = records.select("id", "year").join(has_item, "id", "left").join(has_label, "id", "left")
    out = flagged.groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count("has_item").alias("with_item"), F.count("has_label").alias("with_label"))
    return coverage_of(out)


def coverage_of(out: DataFrame) -> DataFrame:
    """D6 from (year, total, with_item, with_label)."""
    return out.withColumns({"item_pct": percent(F.col("with_item"), F.col("total")), "label_pct": percent(F.col("with_label"), F.col("total"))})


def implausible_years(records: DataFrame, low: int, high: int) -> DataFrame:
    """How many records lie outside the bounds, and the extremes among them. Nothing is deleted."""
    return records.where(~F.col("year").between(low, high)).agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))


def analysis_years(records: DataFrame, floor: int = 500) -> DataFrame:
    """Years with at least `floor` records."""
    return year_totals(records).where(F.col("total") >= floor)


def top_in_year(ranked: DataFrame, year: int | None = None, n: int = 5) -> DataFrame:
    """Rows ranked n or better in a year, by default the latest."""
    chosen = ranked.where(F.col("year") == year) if year else ranked.join(ranked.agg(F.max("year").alias("year")), "year", "left_semi")
    return chosen.where(F.col("rank_in_year") <= n)


def fastest_growing(trend: DataFrame, year: int, min_count: int = 50, n: int = 10) -> DataFrame:
    """Rows of a year with enough records, by growth."""
    return trend.where((F.col("year") == year) & (F.col("n") >= min_count) & F.col("yoy_pct").isNotNull()).orderBy(F.desc("yoy_pct"), "label").limit(n)


def severity_order(severity: Column | str, order: tuple[str, ...] = SEVERITIES) -> Column:
    """Place of a severity in the order; unknown ones come last."""
    severity = F.col(severity) if isinstance(severity, str) else severity
    place = F.lit(len(order))
    for k, name in enumerate(order):
        place = F.when(severity == name, k).otherwise(place)
    return place.cast("long")


def latest_years(totals: DataFrame, n: int = 10) -> DataFrame:
    """The newest n years."""
    return totals.orderBy(F.desc("year")).limit(n)


def snapshot(records: DataFrame, affected: DataFrame, canonical: DataFrame, assignments: DataFrame, year: int, min_count: int = 50) -> DataFrame:
    """One row for a year: total, change on the calendar year before, busiest entity, fastest label, coverage and its change."""
    cover = coverage_by_year(records, affected, assignments)
    now = cover.where(F.col("year") == year).select("year", "total", "item_pct")
    last = cover.where(F.col("year") == year - 1).select(F.lit(year).cast("long").alias("year"), F.col("total").alias("total_before"), F.col("item_pct").alias("pct_before"))
    entity = entity_year_trend(records, affected).where(F.col("year") == year).orderBy(F.desc("n"), "entity").limit(1).select("year", F.col("entity").alias("top_entity"), F.col("n").alias("top_entity_n"))
    label = fastest_growing(label_year_trend(records, canonical), year, min_count, 1).select("year", F.col("label").alias("fastest_label"), F.col("yoy_pct").alias("fastest_pct"))
    out = now.join(last, "year", "left").join(entity, "year", "left").join(label, "year", "left")
    return out.select("year", "total", percent(F.col("total") - F.col("total_before"), F.col("total_before")).alias("change_pct"), "top_entity", "top_entity_n", "fastest_label", "fastest_pct", "item_pct", rounded(F.col("item_pct") - F.col("pct_before"), 1).alias("item_pct_change"))


def undercounted_from(coverage: DataFrame, threshold: float = 85.0, column: str = "item_pct") -> DataFrame:
    """The first year of the run of years below the threshold that reaches the newest year; NULL if the newest is complete."""
    good = coverage.agg(F.max(F.when(F.col(column) >= threshold, F.col("year"))).alias("good"))
    return coverage.crossJoin(good).agg(F.min(F.when(F.col("good").isNull() | (F.col("year") > F.col("good")), F.col("year"))).alias("undercounted_from"))


def default_start(coverage: DataFrame, share: float = 0.02) -> DataFrame:
    """The first year with at least that share of the peak year's records."""
    peak = coverage.agg(F.max("total").alias("peak"))
    return coverage.crossJoin(peak).where(F.col("total") >= share * F.col("peak")).agg(F.min("year").alias("default_start"))


def headline_counts(records: DataFrame, affected: DataFrame, canonical: DataFrame, min_profile: int = 20) -> DataFrame:
    """Records, entities, entities with enough records to profile, labels, and the span of years."""
    per_entity = dedupe_pairs(affected, ["entity"]).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    entities = per_entity.agg(F.count(F.lit(1)).alias("entities"), F.count(F.when(F.col("n") >= min_profile, 1)).alias("profiled"))
    labels = canonical.where(~F.col("generic")).agg(F.count_distinct("label").alias("labels"))
    total = records.agg(F.count(F.lit(1)).alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return total.crossJoin(entities).crossJoin(labels)  # one row each


def top_overall(trend: DataFrame, key: str, n: int) -> DataFrame:
    """Sums over the years, the n largest."""
    return trend.groupBy(key).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), key).limit(n)


def coverage_long(coverage: DataFrame) -> DataFrame:
    """(year, kind, pct)."""
    return coverage.unpivot(["year"], ["item_pct", "label_pct"], "kind", "pct")


def movers(series: DataFrame, key: str, value: str, first: int, second: int, n: int = 5) -> DataFrame:
    """The n largest gains and the n largest losses between two years, among keys present in both."""
    both = series.where(F.col("year").isin(first, second)).groupBy(key).agg(F.max(F.when(F.col("year") == first, F.col(value))).alias("before"), F.max(F.when(F.col("year") == second, F.col(value))).alias("after"))
    change = both.where(F.col("before").isNotNull() & F.col("after").isNotNull()).withColumn("change", F.col("after") - F.col("before"))
    up = change.orderBy(F.desc("change"), key).limit(n).withColumn("direction", F.lit("up"))
    return up.unionByName(change.orderBy("change", key).limit(n).withColumn("direction", F.lit("down")))


def entity_totals(affected: DataFrame, n: int = 10, records: DataFrame | None = None, year: int | None = None) -> DataFrame:
    """Distinct records per entity, the n largest, of all years or one."""
    pairs = dedupe_pairs(affected, ["entity"])
    if year is not None:
        pairs = pairs.join(records.where(F.col("year") == year).select("id"), "id", "left_semi")
    return pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(n)


def counts_by_status(records: DataFrame, rejected: str, text: str | None = None, min_chars: int = 10) -> DataFrame:
    """All records, rejected ones, the rest, and those of the rest whose text is nearly empty."""
    short = F.char_length(F.trim(F.col(text))) < min_chars if text else F.lit(False)
    good = F.col("status") != rejected
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == rejected).alias("rejected"), F.count_if(good).alias("prepared"), F.count_if(good & short).alias("near_empty"))

"""The neighbourhoods of all labels at once (N1-N9); network.py has those of one label.

found is the buckets (entity, item, year, label) of network.buckets(). Pairs are made inside a bucket's row, which holds each label once, and counted by
year before anything else looks at them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import percent, rounded
from tidemark.operators.network import KEY, both_ways


def all_carriers(found: DataFrame) -> DataFrame:
    """(label, year, carriers): buckets that hold each label."""
    return found.groupBy("label", "year").agg(F.count(F.lit(1)).alias("carriers"))


def all_pairings(found: DataFrame) -> DataFrame:
    """(label, partner, entity, item, year) for every two labels of a bucket, both ways."""
    held = found.groupBy(*KEY).agg(F.collect_set("label").alias("__l")).where(F.size("__l") > 1)  # no more than there are labels
    first = held.select(*KEY, "__l", F.explode("__l").alias("label"))
    return first.select("label", F.explode("__l").alias("partner"), *KEY).where(F.col("label") != F.col("partner"))


def pairs_by_year(found: DataFrame) -> DataFrame:
    """(label, partner, year, n): buckets that two labels share; what N4 to N7 count further."""
    return all_pairings(found).groupBy("label", "partner", "year").agg(F.count(F.lit(1)).alias("n"))


def all_summaries(found: DataFrame) -> DataFrame:
    """Per label carriers, partners, buckets shared with any, and their percent."""
    marked = found.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))  # a row per label of a bucket
    totals = marked.groupBy("label").agg(F.count(F.lit(1)).alias("carriers"), F.count_if(F.col("__n") > 1).alias("shared"))
    met = all_pairings(found).select("label", "partner").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("partners"))
    out = totals.join(met, "label", "left").select("label", "carriers", F.coalesce("partners", F.lit(0)).alias("partners"), "shared")
    return out.withColumn("shared_pct", percent(F.col("shared"), F.col("carriers"), 2))


def all_partners(found: DataFrame) -> DataFrame:
    """Per label and partner shared buckets, first year, percent of the label's carriers."""
    totals = found.groupBy("label").agg(F.count(F.lit(1)).alias("carriers"))
    out = pairs_by_year(found).groupBy("label", "partner").agg(F.sum("n").alias("shared"), F.min("year").alias("first_year")).join(totals, "label")
    return out.withColumn("share_pct", percent(F.col("shared"), F.col("carriers"), 2)).drop("carriers")


def all_recent_shifts(found: DataFrame, width: int = 3) -> DataFrame:
    """Percentage points between a partner's share of the label's carriers in its last `width` years with carriers and in
    the `width` before; NULL without such years."""
    back = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("year")))  # a row per year
    years = all_carriers(found).withColumn("w", F.when(back <= width, "now").when(back <= 2 * width, "then"))
    totals = years.groupBy("label").agg(F.sum(F.when(F.col("w") == "now", F.col("carriers"))).alias("n_now"), F.sum(F.when(F.col("w") == "then", F.col("carriers"))).alias("n_then"))
    in_window = lambda w: F.coalesce(F.sum(F.when(F.col("w") == w, F.col("n"))), F.lit(0)).alias(w)
    met = pairs_by_year(found).join(years.select("label", "year", "w"), ["label", "year"]).groupBy("label", "partner").agg(in_window("now"), in_window("then"))
    shift = 100.0 * (F.col("now") / F.col("n_now") - F.col("then") / F.col("n_then"))
    return met.join(totals, "label").select("label", "partner", rounded(shift, 4).alias("shift"))


def all_drawn(found: DataFrame, pruned: DataFrame) -> DataFrame:
    """Per label its partners, and whether the edge between them is kept."""
    kept = both_ways(pruned).select(F.col("src").alias("label"), F.col("dst").alias("partner"), F.lit(True).alias("drawn")).distinct()
    return all_pairings(found).select("label", "partner").distinct().join(kept, ["label", "partner"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(False)))


def all_year_shares(found: DataFrame, top: int = 8, min_carriers: int = 10) -> DataFrame:
    """Percent of a year's carriers for each label's biggest partners, in years with enough carriers; absent is 0."""
    counts = pairs_by_year(found)
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("shared"), "partner"))  # a row per partner
    chosen = counts.groupBy("label", "partner").agg(F.sum("n").alias("shared")).withColumn("place", place).where(F.col("place") <= top).select("label", "partner")
    grid = all_carriers(found).where(F.col("carriers") >= min_carriers).join(chosen, "label")  # years by `top` partners
    out = grid.join(counts, ["label", "partner", "year"], "left")
    return out.select("label", "partner", "year", F.coalesce(percent(F.col("n"), F.col("carriers"), 2), F.lit(0.0)).alias("share_pct"))


def all_drivers(found: DataFrame) -> DataFrame:
    """Per label and partner the entities and items where they meet, with years."""
    years = [F.count(F.lit(1)).alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year")]  # a bucket is one year
    return all_pairings(found).groupBy("label", "partner", "entity", "item").agg(*years)


def all_hubs(found: DataFrame, n: int = 15) -> DataFrame:
    """Per label the n entities and items where it meets the most partners, with years."""
    met = all_pairings(found).groupBy("label", "entity", "item").agg(F.count_distinct("partner").alias("partners"), F.count_distinct("year").alias("years"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("partners"), F.desc("years"), "entity", "item"))  # Spark keeps n a task before the rows meet
    return met.withColumn("place", place.cast("long")).where(F.col("place") <= n)

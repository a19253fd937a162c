"""Co-occurrence of labels (E1-E5, E10-E18) and the neighbourhood of one label.

buckets are (entity, item, year, label), each once; edges are (src, dst, weight) with src < dst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import percent, rounded

KEY = ["entity", "item", "year"]


def buckets(affected: DataFrame, records: DataFrame, canonical: DataFrame) -> DataFrame:
    """Each (entity, item, year, non-generic canonical label) once."""
    label = canonical.where(~F.col("generic")).select("id", "label")
    return affected.select("id", "entity", "item").distinct().join(records.select("id", "year"), "id").join(label, "id").select(*KEY, "label").distinct()


def cooccurrence(found: DataFrame, key: list[str] = KEY) -> DataFrame:
    """In how many buckets two labels meet. A bucket's labels are distinct, so its pairs are bounded by the
    label universe; pairs are made within the bucket's row and added up before they are shuffled."""
    labels = found.groupBy(*key).agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)
    first = labels.select("labels", F.posexplode("labels").alias("at", "src"))
    pairs = first.select("src", F.explode(F.slice("labels", F.col("at") + 2, F.size("labels"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def label_index(canonical: DataFrame) -> DataFrame:
    """Every non-generic canonical label with its frequency, numbered by numeric suffix (others last), then name."""
    number = F.expr("try_cast(regexp_extract(label, '([0-9]+)$', 1) AS BIGINT)")
    counts = canonical.where(~F.col("generic")).groupBy("label").agg(F.count(F.lit(1)).alias("frequency"))
    return counts.withColumn("position", F.row_number().over(Window.orderBy(F.asc_nulls_last(number), "label")).cast("long"))  # a row per label


def network_stats(found: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Buckets, those with several labels, edges, density in percent, greatest weight."""
    per_bucket = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m"))
    a = per_bucket.agg(F.count(F.lit(1)).alias("buckets"), F.count_if(F.col("m") > 1).alias("multi"))
    b = edges.agg(F.count(F.lit(1)).alias("edges"), F.max("weight").alias("max_weight"))
    c = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    out = a.crossJoin(b).crossJoin(c)  # one row each
    return out.withColumns({"multi_pct": percent(F.col("multi"), F.col("buckets"), 2), "density_pct": percent(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1), 2)})


def top_pairs(edges: DataFrame, n: int = 10) -> DataFrame:
    """E5."""
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(n)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degree(edges: DataFrame) -> DataFrame:
    """Neighbours per label."""
    return both_ways(edges).groupBy(F.col("src").alias("label")).agg(F.count(F.lit(1)).alias("degree"))


def rank_compare(measures: DataFrame, x: str, y: str) -> DataFrame:
    """Ordinal ranks from 1 (highest) by both measures; the label settles ties. A row per label."""
    ranks = {f"{c}_rank": F.row_number().over(Window.orderBy(F.desc(c), "label")).cast("long") for c in (x, y)}
    return measures.select("label", x, y).withColumns(ranks)


def divergence(measures: DataFrame, x: str, y: str, floor: int = 20, n: int = 10) -> DataFrame:
    """Among labels with x of at least floor, the n that y ranks highest above x and the n farthest below."""
    ranked = rank_compare(measures.where(F.col(x) >= floor), x, y).withColumn("gap", F.col(f"{x}_rank") - F.col(f"{y}_rank"))
    up = ranked.orderBy(F.desc("gap"), "label").limit(n).withColumn("side", F.lit("above"))
    return up.unionByName(ranked.orderBy("gap", "label").limit(n).withColumn("side", F.lit("below")))


def prune_top_k(edges: DataFrame, k: int = 5) -> DataFrame:
    """Edges that either end ranks among its k heaviest; the neighbour's name settles ties."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    kept = both_ways(edges.where("weight > 0")).withColumn("place", place).where(F.col("place") <= k)
    return kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").distinct()


def isolated(nodes: DataFrame, pruned: DataFrame) -> DataFrame:
    """Labels without a kept edge."""
    return nodes.select("label").join(degree(pruned), "label", "left_anti")


def node_table(index: DataFrame, centrality: DataFrame, pruned: DataFrame) -> DataFrame:
    """Label, frequency, centrality, degree among kept edges, is_isolated."""
    out = index.select("label", "frequency").join(centrality.select("label", "centrality"), "label", "left").join(degree(pruned), "label", "left")
    return out.select("label", "frequency", F.coalesce("centrality", F.lit(0.0)).alias("centrality"), F.coalesce("degree", F.lit(0)).alias("degree"), F.col("degree").isNull().alias("is_isolated"))


def edges_min_weight(edges: DataFrame, weight: int) -> DataFrame:
    """E17."""
    return edges.where(F.col("weight") >= weight)


def value_rank(measures: DataFrame, column: str) -> DataFrame:
    """1 plus the number of strictly greater values. A row per label."""
    return measures.withColumn("rank", F.rank().over(Window.orderBy(F.desc(column))).cast("long"))


# -- the neighbourhood of one label ------------------------------------------------------------------


def carriers(found: DataFrame, label: str) -> DataFrame:
    """Buckets that hold the label."""
    return found.where(F.col("label") == label).select(*KEY)


def pairings(found: DataFrame, label: str) -> DataFrame:
    """(year, partner, entity, item) of buckets that the label shares."""
    return found.where(F.col("label") != label).join(carriers(found, label), KEY, "left_semi").select("year", F.col("label").alias("partner"), "entity", "item")


def summary(found: DataFrame, label: str) -> DataFrame:
    """Carriers, partners, percent of carriers with a partner."""
    pairs = pairings(found, label)
    a = carriers(found, label).agg(F.count(F.lit(1)).alias("carriers"))
    b = pairs.agg(F.count_distinct("partner").alias("partners"), F.count_distinct(*KEY).alias("shared"))
    return a.crossJoin(b).withColumn("shared_pct", percent(F.col("shared"), F.col("carriers"), 2))  # one row each


def partners(found: DataFrame, label: str) -> DataFrame:
    """Per partner shared buckets, percent of carriers, first year."""
    total = carriers(found, label).agg(F.count(F.lit(1)).alias("carriers"))
    out = pairings(found, label).groupBy("partner").agg(F.count(F.lit(1)).alias("shared"), F.min("year").alias("first_year")).crossJoin(F.broadcast(total))
    return out.withColumn("share_pct", percent(F.col("shared"), F.col("carriers"), 2)).drop("carriers")


def recent_shift(found: DataFrame, label: str, width: int = 3) -> DataFrame:
    """Percentage points between a partner's share of carriers in the last `width` years that have carriers and
    in the `width` before; NULL without such years."""
    years = carriers(found, label).groupBy("year").agg(F.count(F.lit(1)).alias("n")).withColumn("back", F.row_number().over(Window.orderBy(F.desc("year"))))  # a row per year
    window = F.when(F.col("back") <= width, "now").when(F.col("back") <= 2 * width, "then")
    years = years.withColumn("w", window).where(F.col("w").isNotNull())
    totals = years.agg(F.sum(F.when(F.col("w") == "now", F.col("n"))).alias("n_now"), F.sum(F.when(F.col("w") == "then", F.col("n"))).alias("n_then"))
    found_in = pairings(found, label).join(F.broadcast(years.select("year", "w")), "year", "left").groupBy("partner").agg(F.count_if(F.col("w") == "now").alias("now"), F.count_if(F.col("w") == "then").alias("then"))
    shift = 100.0 * (F.col("now") / F.col("n_now") - F.col("then") / F.col("n_then"))
    return found_in.crossJoin(F.broadcast(totals)).select("partner", rounded(shift, 4).alias("shift"))


def drawn(found: DataFrame, label: str, pruned: DataFrame) -> DataFrame:
    """Partners, and whether their edge to the label is kept."""
    kept = both_ways(pruned).where(F.col("src") == label).select(F.col("dst").alias("partner"), F.lit(True).alias("drawn"))
    return pairings(found, label).select("partner").distinct().join(kept, "partner", "left").withColumn("drawn", F.coalesce("drawn", F.lit(False)))


def year_shares(found: DataFrame, label: str, top: int = 8, min_carriers: int = 10) -> DataFrame:
    """Percent of each year's carriers for the biggest partners, in years with enough carriers; absent is 0."""
    chosen = partners(found, label).orderBy(F.desc("shared"), "partner").limit(top).select("partner")
    years = carriers(found, label).groupBy("year").agg(F.count(F.lit(1)).alias("carriers")).where(F.col("carriers") >= min_carriers)
    counts = pairings(found, label).groupBy("partner", "year").agg(F.count(F.lit(1)).alias("n"))
    grid = years.crossJoin(chosen)  # years by `top` partners
    return grid.join(counts, ["partner", "year"], "left").select("partner", "year", F.coalesce(percent(F.col("n"), F.col("carriers"), 2), F.lit(0.0)).alias("share_pct"))


def drivers(found: DataFrame, label: str, partner: str) -> DataFrame:
    """Entities and items where the two meet, with years."""
    return pairings(found, label).where(F.col("partner") == partner).groupBy("entity", "item").agg(F.count_distinct("year").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def hubs(found: DataFrame, label: str, n: int = 15) -> DataFrame:
    """Entities and items where the label meets the most partners."""
    out = pairings(found, label).groupBy("entity", "item").agg(F.count_distinct("partner").alias("partners"), F.count_distinct("year").alias("years"))
    return out.orderBy(F.desc("partners"), F.desc("years"), "entity", "item").limit(n)

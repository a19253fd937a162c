"""Column helpers that give the same digits on every engine, and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import cut


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding by floor; Spark's round() and other engines' differ on values such as 1.005."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def exact_sum(x: Column | str, digits: int = 2) -> Column:
    """Sum of money-like doubles that does not depend on the order of addition."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(x.cast(f"decimal(18,{digits})")).cast("double")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, NULL where whole is 0."""
    return rounded(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def average_rank(df: DataFrame, column: str, name: str, *, by: list[str] | None = None) -> DataFrame:
    """df with ranks from 1 (lowest) in which ties share their average."""
    ranked = Window.partitionBy(*(by or [])).orderBy(column)
    tied = Window.partitionBy(*(by or []), column)
    return df.withColumn(name, F.rank().over(ranked) + (F.count(F.lit(1)).over(tied) - 1) / 2.0)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho (Pearson on average-tie ranks) and t = rho * sqrt((n - 2) / (1 - rho^2)).

    Ranks come from counts per distinct value, in ranges between approximate quantiles: a task sorts a range, and
    the ranges' totals (a row each) shift its ranks.
    """
    both = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "pairs")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ranks(c: str) -> DataFrame:
        per_value = both.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        edges = sorted(set(per_value.approxQuantile(c, [k / parts for k in range(1, parts)], 0.5 / parts))) if parts > 1 else []
        part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(c))) if edges else F.lit(0)
        placed = per_value.withColumn("part", part)
        totals = placed.groupBy("part").agg(F.sum("n").alias("all"))
        before = totals.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per range
        below = F.sum("n").over(Window.partitionBy("part").orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        return placed.join(before, "part").select(c, (F.col("before") + F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / 2.0).alias(f"r{c}"))

    joined = both.join(ranks("x"), "x").join(ranks("y"), "y")
    out = joined.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))
    return out.withColumn("t", F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0))))


def entropy(df: DataFrame, group: list[str], item: str) -> DataFrame:
    """Shannon entropy in bits of the items of each group (NULL items aside); 0 where there are none."""
    counts = df.groupBy(*group, item).agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col(item).isNotNull(), F.col("n")).otherwise(0))
    total = counts.withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    p = F.col("n") / F.nullif(F.col("total"), F.lit(0))
    return total.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("n") > 0, -p * F.log2(p))), F.lit(0.0)).alias("entropy"))

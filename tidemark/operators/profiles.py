"""Profiles of entities and archetypes."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import dealt
from tidemark.operators.manykmeans import scan

# fixed values: two families of labels by which clusters are named, and the name of clusters that neither marks
FAMILIES = {
    "Memory-safety-heavy": ["CWE-119", "CWE-120", "CWE-122", "CWE-125", "CWE-190", "CWE-415", "CWE-416", "CWE-476", "CWE-787", "CWE-908"],
    "Web-injection-heavy": ["CWE-22", "CWE-74", "CWE-77", "CWE-78", "CWE-79", "CWE-89", "CWE-94", "CWE-98", "CWE-352", "CWE-434"],
}
DIFFUSE = "Diffuse (no dominant category)"


def entity_shares(affected: DataFrame, canonical_top: DataFrame, min_total: int = 20, by: list[str] | None = None) -> DataFrame:
    """F2, long form: (entity, label, share, total): shares of top labels among an entity's non-generic records, for
    entities with min_total labelled or generic records. Records without any label count nowhere; an
    entity with generic ones alone has one row without a label and share 0.

    canonical_top is (id, top_label), NULL if generic; by adds columns of it (such as the year) to the key.
    """
    return shares_of_counts(top_counts(affected, canonical_top, by), min_total, by)


def top_counts(affected: DataFrame, canonical_top: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(entity, by, top_label, n): an entity's records by top label, NULL for generic ones."""
    pairs = affected.select("id", "entity").distinct().join(canonical_top, "id")
    return pairs.groupBy("entity", *(by or []), "top_label").agg(F.count(F.lit(1)).alias("n"))


def shares_of_counts(counts: DataFrame, min_total: int = 20, by: list[str] | None = None) -> DataFrame:
    """F2's shares from top_counts(), which may be by more columns than asked for."""
    key = ["entity", *(by or [])]
    of = Window.partitionBy(*key)  # a row per top label
    summed = counts.groupBy(*key, F.col("top_label").alias("label")).agg(F.sum("n").alias("n"))
    labelled = F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).over(of), F.lit(0))
    rows = summed.withColumns({"total": F.sum("n").over(of), "labelled": labelled}).where((F.col("total") >= min_total) & (F.col("label").isNotNull() | (F.col("labelled") == 0)))
    share = F.when(F.col("label").isNotNull(), F.col("n") / F.col("labelled")).otherwise(0.0)
    return rows.select(*key, "label", share.alias("share"), "total")


def wide_shares(shares: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per entity with a column per label of an explicit list; absent shares are 0."""
    key = ["entity", *(by or [])]
    return shares.groupBy(*key, "total").pivot("label", labels).agg(F.first("share")).fillna(0.0)


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    scaled = df.crossJoin(F.broadcast(stats))  # one row
    out = scaled.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns})
    return out.select(*df.columns)


def fit_pca(df: DataFrame, columns: list[str], k: int = 2) -> PipelineModel:
    """assemble, centre and scale, project; the last stage has explainedVariance and pc."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), PCA(k=k, inputCol="scaled", outputCol="pca")]).fit(df)


def _best_start(scaled: DataFrame, k: int, seeds: int, seed: int, column: str = "pca", at_once: int = 5):
    """The k-means model with the least cost of several starts, each until it rests or for 300 rounds. Starts know nothing of each
    other, so `at_once` of them run as jobs side by side over the same cached rows."""
    fit = inheritable_thread_target(scaled.sparkSession)(lambda s: KMeans(k=k, seed=seed + s, featuresCol=column, predictionCol="cluster", maxIter=300).fit(scaled))
    with ThreadPool(max(1, min(at_once, seeds))) as pool:
        models = pool.map(fit, range(seeds), chunksize=1)
    return min(models, key=lambda m: m.summary.trainingCost)


def kmeans_scan(df: DataFrame, ks: range = range(2, 11), seeds: int = 10, seed: int = 42, column: str = "pca") -> list[dict]:
    """for each k the best of several starts by cost, with its silhouette, over the components of fit_pca(). `best` marks the highest
    silhouette and `at_edge` warns that it is the last k tried. All models share their scans; see manykmeans.scan()."""
    out = [{"k": m["k"], "cost": m["cost"], "silhouette": m["silhouette"]} for m in scan(df, column, ks, seeds, seed)]
    top = max(out, key=lambda r: (r["silhouette"], -r["k"]), default=None)
    return [r | {"best": r is top, "at_edge": r is top and r["k"] == out[-1]["k"]} for r in out]


def fit_archetypes(df: DataFrame, columns: list[str], ks: range = range(2, 11), seeds: int = 10, seed: int = 42) -> PipelineModel:
    """one pipeline of scaler, PCA and k-means over the components at the k that the scan marks as best, to be saved and used on later data."""
    base = fit_pca(df, columns)
    parts = dealt(base.transform(df).select("pca"), "components").persist()
    k = next(r["k"] for r in kmeans_scan(parts, ks, seeds, seed) if r["best"])
    kmeans = _best_start(parts, k, seeds, seed)
    parts.unpersist()
    return PipelineModel(stages=[*base.stages, kmeans])


def cluster_profile(df: DataFrame, columns: list[str], cluster: str = "cluster", top: int = 5) -> DataFrame:
    """(cluster, label, mean_share, place, size): mean raw shares, the `top` greatest marked by place."""
    long = df.select(cluster, *columns).unpivot([cluster], columns, "label", "share")
    means = long.groupBy(cluster, "label").agg(F.avg("share").alias("mean_share"), F.count(F.lit(1)).alias("size"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("mean_share"), "label")).cast("long"))


def name_clusters(profile: DataFrame, families: dict[str, list[str]] | None = None, other: str = "Other", cluster: str = "cluster") -> DataFrame:
    """F8: the family with the larger summed share (the first wins ties), or DIFFUSE where `other` exceeds all."""
    families = families or FAMILIES
    sums = profile.groupBy(cluster).agg(*[F.coalesce(F.sum(F.when(F.col("label").isin(*m), F.col("mean_share"))), F.lit(0.0)).alias(n) for n, m in families.items()], F.coalesce(F.sum(F.when(F.col("label") == other, F.col("mean_share"))), F.lit(0.0)).alias("__other"))
    most = F.greatest(*[F.col(n) for n in families])
    name = F.lit(None).cast("string")
    for n in reversed(list(families)):
        name = F.when(F.col(n) == most, n).otherwise(name)
    return sums.withColumn("name", F.when(F.col("__other") > most, DIFFUSE).otherwise(name)).drop("__other")


def entity_map(model: Transformer, wide: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """entities with two components, cluster and, if given, the cluster's name."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(wide).withColumn("p", vector_to_array("pca"))
    out = out.withColumns({"pc1": F.col("p")[0], "pc2": F.col("p")[1]}).drop("p", "features", "scaled", "pca")
    return out if names is None else out.join(F.broadcast(names.select("cluster", "name")), "cluster", "left")


def score_by_year(model: Transformer, wide_by_year: DataFrame, pooled: DataFrame) -> DataFrame:
    """(entity, year, cluster) of pooled entities through the fixed model."""
    return model.transform(wide_by_year.join(pooled.select("entity"), "entity", "left_semi")).select("entity", "year", "cluster")


def stability(assigned: DataFrame) -> DataFrame:
    """entities with two years or more: stable with one archetype, else drifted."""
    per = assigned.groupBy("entity").agg(F.count_distinct("cluster").alias("c"), F.count_distinct("year").alias("y")).where("y >= 2")
    return per.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("c") == 1).alias("stable"), F.count_if(F.col("c") > 1).alias("drifted"))


def latest_agreement(assigned: DataFrame, pooled: DataFrame) -> DataFrame:
    """in how many entities the latest year has the pooled archetype."""
    last = assigned.groupBy("entity").agg(F.max_by("cluster", "year").alias("latest"))
    return last.join(pooled.select("entity", F.col("cluster").alias("pooled")), "entity").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("latest") == F.col("pooled")).alias("agree"))


def drift_paths(assigned: DataFrame, n: int = 10) -> DataFrame:
    """drifting entities with the most years, and their path `year->cluster`."""
    steps = F.array_sort(F.collect_set(F.struct("year", "cluster")))
    per = assigned.groupBy("entity").agg(F.count_distinct("cluster").alias("clusters"), F.count_distinct("year").alias("years"), steps.alias("steps")).where("clusters > 1")
    path = F.array_join(F.transform("steps", lambda s: F.concat(s["year"].cast("string"), F.lit("->"), s["cluster"].cast("string"))), ", ")
    return per.orderBy(F.desc("years"), "entity").limit(n).select("entity", "years", path.alias("path"))


def top_shares(shares: DataFrame, entity, n: int = 10) -> DataFrame:
    """the largest shares of an entity."""
    return shares.where((F.col("entity") == entity) & F.col("label").isNotNull()).orderBy(F.desc("share"), "label").limit(n).select("label", "share")


def archetype_counts(assigned: DataFrame, examples: int = 6) -> DataFrame:
    """entities per archetype, and the first few by name."""
    first = F.row_number().over(Window.partitionBy("cluster").orderBy("entity"))
    named = assigned.withColumn("place", first).where(F.col("place") <= examples).groupBy("cluster").agg(F.array_sort(F.collect_list("entity")).alias("examples"))
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("entities")).join(named, "cluster")


def explained_variance(model: PipelineModel) -> list[tuple[int, float]]:
    """(component, part of the variance), of the PCA in a fitted pipeline."""
    return [(k + 1, float(v)) for stage in model.stages if isinstance(stage, PCAModel) for k, v in enumerate(stage.explainedVariance)]

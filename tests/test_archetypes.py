"""The scan covers the reference's range and starts, and archetypes take its verdict."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import manykmeans, profiles
from tidemark.plans import model_queries


def test_registered_scan_covers_the_reference(spark, monkeypatch):
    tried, scan = [], profiles.scan
    monkeypatch.setattr(profiles, "scan", lambda df, column, ks, starts, seed: tried.append((column, list(ks), starts)) or scan(df, column, ks, 2, seed))
    rows = model_queries.QUERIES["kmeans_scan"](spark, "/root/testdata/sf0.001").collect()
    assert tried == [("pca", list(range(2, 11)), 10)] and [r["k"] for r in rows] == list(range(2, 11))
    assert sum(r["best"] for r in rows) == 1


def test_scan_agrees_with_single_models(spark):
    """Each model of the scan rests where Lloyd's rounds from its own centroids do, and costs and silhouettes are those of Spark's own tools."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (40 + 20 * i, 2)) for i, c in enumerate([(0, 0), (4, 0), (0, 5)])])
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x.tolist()], ["pca"])
    found = manykmeans.scan(df, "pca", range(2, 5), 10, 42)
    for m in found:
        far = ((x[:, None] - m["centers"][None]) ** 2).sum(2)
        own = far.argmin(1)
        assert np.isclose(far.min(1).sum(), m["cost"]) and np.allclose([x[own == k].mean(0) for k in range(m["k"])], m["centers"])
        marked = spark.createDataFrame([(Vectors.dense(r), int(k)) for r, k in zip(x.tolist(), own)], ["pca", "cluster"])
        assert np.isclose(ClusteringEvaluator(featuresCol="pca", predictionCol="cluster").evaluate(marked), m["silhouette"])
        single = min(KMeans(k=m["k"], seed=s, featuresCol="pca", maxIter=300).fit(df).summary.trainingCost for s in range(3))
        assert m["cost"] <= single * 1.02
    assert max(found, key=lambda m: m["silhouette"])["k"] == 3


def test_scan_of_few_points(spark):
    from pyspark.ml.linalg import Vectors

    one = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)] * 3, ["pca"])
    assert [(m["cost"], m["silhouette"]) for m in manykmeans.scan(one, "pca", range(2, 4), 2, 1)] == [(0.0, 0.0)] * 2
    assert manykmeans.scan(one.limit(0), "pca", range(2, 4), 2, 1) == []


def test_archetypes_take_the_best_k(spark, monkeypatch):
    labels = list("abcdef")
    shares = spark.range(36).select(F.concat(F.lit("e"), "id").alias("entity"), F.element_at(F.array(*map(F.lit, labels)), (F.col("id") % 6 + 1).cast("int")).alias("label"), (1 - F.col("id") / 1000).alias("share"), F.lit(20).cast("long").alias("total"))
    monkeypatch.setattr(model_queries, "_shares", lambda x: shares)
    monkeypatch.setattr(model_queries, "_labels", lambda x: labels)
    model, wide, _, _ = model_queries._archetypes(None)
    assert len(model.stages[-1].clusterCenters()) == 6
    assert model.transform(wide).select("cluster").distinct().count() == 6


def test_stability_follows_the_archetypes(spark, monkeypatch):
    """F10 to F13 in a chain: entities that change their label in the second year drift."""
    labels = list("abc")
    rows = [(f"e{k}", labels[k % 3], 1.0, 20, None) for k in range(18)]
    by_year = [(f"e{k}", y, labels[(k + (k < 6 and y == 2002)) % 3], 1.0, 20) for k in range(18) for y in (2001, 2002)]
    pooled = spark.createDataFrame([r[:4] for r in rows], "entity string, label string, share double, total long")
    yearly = spark.createDataFrame(by_year, "entity string, year long, label string, share double, total long")
    monkeypatch.setattr(model_queries, "_shares", lambda x, by=None: yearly if by else pooled)
    monkeypatch.setattr(model_queries, "_labels", lambda x: labels)
    row = model_queries._archetype_stability(None).collect()
    assert [tuple(r) for r in row] == [(18, 12, 6, 18, 12)]
    assert {r["entity"] for r in profiles.drift_paths(model_queries._archetype_by_year(None)).collect()} == {f"e{k}" for k in range(6)}


def test_models_are_fitted_once_for_equal_rows(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    from tidemark.functions.shared import remove_tables
    from tidemark.sources.tables import fitted_once

    fits = []

    def fit(df):
        fits.append(df.count())
        return Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v")]).fit(df)

    rows = [(float(k % 7), k) for k in range(40)]
    df = spark.createDataFrame(rows, "x double, `a.b` long")
    fitted_once(df, "m", fit, 3)
    model = fitted_once(spark.createDataFrame(rows[::-1], df.schema).repartition(3), "m", fit, 3)  # the same rows in another order
    assert fits == [40] and model.transform(df).first()["v"][0] == 0.0
    fitted_once(df, "m", fit, 4)
    fitted_once(df.unionByName(df.limit(1)), "m", fit, 3)
    assert fits == [40, 40, 41]
    remove_tables(spark)
    fitted_once(df, "m", fit, 3)
    assert fits == [40, 40, 41, 40]


def test_scan_of_a_small_table_takes_all_cores_and_no_shuffle(spark, monkeypatch):
    """Before, a table in one file was one task in every round, and sums were shuffled."""
    from pyspark.ml.linalg import Vectors

    seen, plain = [], manykmeans._pass
    monkeypatch.setattr(manykmeans, "_pass", lambda points, centers: seen.append(points.rdd.getNumPartitions()) or plain(points, centers))
    df = spark.createDataFrame([(Vectors.dense([float(i % 7), float(i % 5)]),) for i in range(400)], ["pca"]).coalesce(1)
    found = manykmeans.scan(df, "pca", range(2, 4), 2, 3)
    assert len(found) == 2 and min(seen) >= spark.sparkContext.defaultParallelism
    n, total, _, cost = manykmeans._pass(df.select(F.array(F.lit(1.0), F.lit(3.0)).alias("x")).repartition(3), [np.zeros((2, 2)), np.array([[1.0, 2.0]])])[1]
    assert n.tolist() == [400] and total.tolist() == [[400, 1200]] and cost == 400


def test_labels_are_settled_once_for_all_shares(spark, monkeypatch):
    """Archetypes by year settled canonical labels five times; now once, and the shares of all years follow from those by year."""
    from tidemark.operators import labels as L
    from tidemark.plans.roles import Roles

    calls, plain = [], Roles.canonical
    monkeypatch.setattr(Roles, "canonical", lambda x: calls.append(1) or plain(x))
    x = Roles(spark, "/root/testdata/sf0.001")
    yearly, pooled, labels = model_queries._shares(x, ["year"]), model_queries._shares(x), model_queries._labels(x)
    assert len(calls) == 1 and len(labels) == 21
    top = L.with_top_label(plain(x), 20)

    def shares(df, *key):
        return {(*[r[k] for k in key], r["entity"], r["label"]): (round(r["share"], 12), r["total"]) for r in df.collect()}

    def plainly(least, by=()):
        by = list(by)
        pairs = x.affected().select("id", "entity").distinct().join(top.join(x.records().select("id", "year"), "id") if by else top, "id").collect()
        of = {}
        for r in pairs:
            of.setdefault((*[r[k] for k in by], r["entity"]), []).append(r["top_label"])
        out = {}
        for key, got in of.items():
            known = [v for v in got if v is not None]
            if len(got) >= least:
                out |= {(*key, v): (round(known.count(v) / len(known), 12), len(got)) for v in set(known)} or {(*key, None): (0.0, len(got))}
        return out

    assert shares(pooled) == plainly(20) and shares(yearly, "year") == plainly(5, ["year"])

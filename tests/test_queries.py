"""Every query with SQL gives the rows that DuckDB gives; the others keep their invariants."""

import math
import os
import random

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(tuple(str(plain(r[c])) for c in want.columns) for r in df.collect())
    assert got == sorted(tuple(str(plain(v)) for v in row) for row in want.fetchall())


def test_every_document_gets_one_cluster(spark):
    rows = catalog.QUERIES["cluster_docs"](spark, "/root/testdata/sf0.01").collect()
    assert rows and len({(r["grp"], r["id"]) for r in rows}) == len(rows)
    assert all(0 <= r["cluster"] < 10 for r in rows)


def test_chain_from_texts_to_flags(spark):
    rows = catalog.QUERIES["found_flags"](spark, "/root/testdata/sf0.01").collect()
    assert rows and len({(r["grp"], r["cluster"]) for r in rows}) == len(rows)
    assert any(r["flagged"] for r in rows) and all(0 < r["cohesion"] <= 1 + 1e-9 for r in rows)
    assert all(r["size"] >= 5 for r in rows if r["flagged"]) and all(r["top_terms"] for r in rows)


def test_chains_over_found_values(spark):
    """Ranks, drift and reports run over what the operators before them find."""
    folder = "/root/testdata/sf0.01"
    drift = catalog.QUERIES["found_drift"](spark, folder).collect()
    assert any(r["drift"] > 0 for r in drift) and all(0 <= r["drift"] <= 1 for r in drift)
    ranks = catalog.QUERIES["central_ranks"](spark, folder).collect()
    assert sorted(r["centrality_rank"] for r in ranks) == list(range(1, len(ranks) + 1))
    assert all(r["rank"] <= r["centrality_rank"] for r in ranks)
    cells = catalog.QUERIES["classified_confusion"](spark, SF).collect()
    assert sum(c["n"] for c in cells if c["label"] == c["predicted"]) > 0.8 * sum(c["n"] for c in cells) > 0


def test_silhouette_is_that_of_all_distances(spark):
    from tidemark.operators import textclusters

    rng, rows, given = random.Random(4), [], []
    for grp, n in (("g", 25), ("h", 6), ("one", 3)):
        for i in range(n):
            w = {t: rng.random() for t in rng.sample("abcdefgh", 3)}
            scale = math.sqrt(sum(v * v for v in w.values()))
            rows += [(grp, i, t, v / scale) for t, v in w.items()]
            given.append((grp, i, 9 if grp == "h" and i == 5 else 0 if grp == "one" else i % 3))
    given.append(("g", 99, 1))  # without weights
    got = {r["grp"]: r for r in textclusters.silhouette(spark.createDataFrame(rows, "grp string, id long, term string, w double"), spark.createDataFrame(given, "grp string, id long, cluster long")).collect()}
    for grp in ("g", "h"):
        vectors = {i: {t: w for g, k, t, w in rows if (g, k) == (grp, i)} for g, i, _ in given if g == grp and i != 99}
        of = {i: c for g, i, c in given if g == grp and i != 99}
        away = lambda i, j: math.dist(*[[vectors[k].get(t, 0) for t in "abcdefgh"] for k in (i, j)])  # noqa: E731, B023
        total = 0.0
        for i in of:
            mean = {c: [away(i, j) for j in of if of[j] == c and j != i] for c in set(of.values())}
            if mean[of[i]]:
                a, b = sum(mean[of[i]]) / len(mean[of[i]]), min(sum(v) / len(v) for c, v in mean.items() if c != of[i])
                total += (b - a) / max(a, b)
        assert got[grp]["documents"] == len(of) and abs(got[grp]["silhouette"] - total / len(of)) < 1e-9
    assert got["one"]["silhouette"] is None


def test_chain_from_centrality_to_the_forecast(spark, monkeypatch):
    from tidemark.operators import forecast

    fit = forecast.fit_change_model
    monkeypatch.setattr(forecast, "fit_change_model", lambda examples, **k: fit(examples, **(k | {"trees": 3})))
    rows = catalog.QUERIES["centrality_backtest"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r["model_mae"] > 0 and 0 <= r["model_direction_acc"] <= 1 and r["n_train"] >= 50 for r in rows)


def test_centrality_is_that_of_a_dense_solver(spark):
    row = catalog.QUERIES["verify_centrality"](spark, SF).collect()
    assert [r["agrees"] for r in row] == [True]


def test_no_window_sorts_all_rows_of_a_year(spark):
    """Windows by year alone run over aggregated counts."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    def by_year(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return [line for line in plan.splitlines() if "Window [" in line and line.split("], [")[1].startswith("year#")]

    for name in ("entity_rank_by_year", "item_year_trend"):
        at = by_year(catalog.QUERIES[name](spark, SF))
        assert at and all("__rows" in line for line in at)
    rows = spark.range(10).select(F.col("id").alias("n"), (F.col("id") % 3).alias("year"))
    at = by_year(rows.withColumn("place", F.rank().over(Window.partitionBy("year").orderBy("n"))))
    assert at and not any("__rows" in line for line in at)


def test_a_model_is_saved_and_read_back(spark, tmp_path):
    from tidemark.operators import profiles
    from tidemark.sources import tables

    df = spark.createDataFrame([(float(k % 5), float(k * k % 7)) for k in range(50)], "a double, b double")
    model = profiles.fit_pca(df, ["a", "b"])
    tables.save_model(model, str(tmp_path / "m"))
    again = tables.load_model(str(tmp_path / "m"))
    assert again.transform(df).select("pca").collect() == model.transform(df).select("pca").collect()
    assert abs(sum(v for _, v in profiles.explained_variance(again)) - 1) < 1e-9


def test_classifier_learns_languages(spark):
    rows = catalog.QUERIES["classify_lang"](spark, "/root/testdata/sf0.01").collect()
    known = [r for r in rows if r["label"] != "Other"]
    assert sum(r["label"] == r["predicted"] for r in known) > 0.9 * len(known)


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0

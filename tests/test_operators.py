"""Small fixtures with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import classify, forecast, search, text, trends

# yearly totals and coverage of a public collection of advisories, typed in
COVERAGE = [(1999, 894, 99.0), (2000, 1020, 98.0), (2001, 8100, 97.0), (2022, 25000, 94.9), (2023, 29000, 93.1), (2024, 40000, 79.1), (2025, 48000, 60.4), (2026, 30000, 46.9)]


def test_coverage_thresholds(spark):
    cover = spark.createDataFrame([(y, n, p) for y, n, p in COVERAGE], "year long, total long, item_pct double")
    assert trends.undercounted_from(cover, 85.0).first()[0] == 2024
    assert trends.undercounted_from(cover, 40.0).first()[0] is None
    assert trends.default_start(cover, 0.02).first()[0] == 2000


def test_gap_years_count_as_neighbours(spark):
    records = spark.createDataFrame([(1, 2001, 1.0), (2, 2001, 2.0), (3, 2002, 6.0), (4, 2005, None)], "id long, year long, score double")
    affected = spark.createDataFrame([(i, "e", "x", v) for i in (1, 2, 3, 4) for v in ("1", "2")], "id long, entity string, item string, version string")
    last = {r["year"]: r for r in trends.entity_year_trend(records, affected).collect()}[2005]
    assert last["n"] == 1 and last["avg_score"] is None and last["rolling_avg_score"] == 3.0 and last["yoy_pct"] == 0.0


@pytest.mark.parametrize("x, want", [("cve-2026-53900", "CVE-2026-53900"), (" 2026-53900 ", "CVE-2026-53900"), ("CVE-26-1", None), ("log4j", None)])
def test_normalize_id(spark, x, want):
    assert spark.createDataFrame([(x,)], "x string").select(search.normalize_id(F.col("x"))).first()[0] == want


def test_keywords_are_literal(spark):
    rows = spark.createDataFrame([("100% of a_b",), ("100 of aXb",)], "text string")
    assert rows.where(search.has_words(F.col("text"), "100% A_B")).count() == 1


def test_clean_text(spark):
    x = "CVE-2021-44228 in log4j 2.14.1, port 8080: see https://x.y/z for IPv6"
    assert spark.createDataFrame([(x,)], "t string").select(text.clean_text(F.col("t"))).first()[0] == "in log4j port see for ipv6"


def test_quarters_and_k(spark):
    days = spark.createDataFrame([("2023-03-31",), ("2023-04-01",)], "d string").select(text.quarter_of(F.to_date("d"))).collect()
    assert [r[0] for r in days] == ["2023-Q1", "2023-Q2"]
    assert [r[0] for r in spark.createDataFrame([(100,), (525,), (575,)], "n long").select(text.choose_k(F.col("n"))).collect()] == [10, 10, 12]


def test_spearman_with_ties(spark):
    r = stats.spearman(spark.createDataFrame([(1, 1), (2, 2), (2, 3), (3, 4)], "x long, y long"), "x", "y").first()
    assert abs(r["rho"] - 0.94868329805) < 1e-9 and r["n"] == 4


def test_entropy(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", None)], "g string, label string")
    assert {r["g"]: r["entropy"] for r in stats.entropy(rows, ["g"], "label").collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_scores_with_an_unseen_class(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, predicted string")
    r = classify.scores(rows).first()
    assert r["n"] == 4 and r["accuracy"] == 0.5 and abs(r["macro_f1"] - (0.5 + 2 / 3 + 0) / 3) < 1e-12


def test_reversion_finds_the_factor(spark):
    rows = spark.createDataFrame([("a", 1, 100.0, 90.0), ("b", 1, 200.0, 180.0)], "label string, year long, value double, next double")
    assert abs(forecast.fit_reversion(rows).first()["c"] - 0.9) < 1e-9


def test_questions_name_ids_however_written(spark):
    from tidemark.operators import facts

    texts = spark.createDataFrame([(1, "Is CWE 79 or cwe89 worse than CWE-22 at -acme and c++ in CVE-2024-12345?"), (2, None), (3, "trend micro, cve 2020 11111 cve2021-22222 CVE-2020-11111 acme in 2019 or 1979 cwe-1 CWE-1")], "id long, text string")
    known = spark.createDataFrame([("acme",), ("c",), ("trend_micro",)], "entity string")
    got = {r["id"]: (r["records"], r["entities"], r["labels"], r["years"]) for r in facts.extract_entities(texts, known).collect()}
    assert got[1] == (["CVE-2024-12345"], ["acme", "c"], ["CWE-79", "CWE-89", "CWE-22"], [])
    assert got[2] == ([], [], [], [])
    assert got[3] == (["CVE-2020-11111", "CVE-2021-22222"], ["acme", "trend_micro"], ["CWE-1"], ["2019"])

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds, tables
from tidemark.streaming import incremental


def item(i, text="a flaw", **more):
    return {"id": i, "published": "2023-05-06T01:02:03.000", "lastModified": "2023-05-07T00:00:00.000", "vulnStatus": "Analyzed", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": text}], **more}


def metric(kind, score, severity="HIGH", entry=None):
    return {"source": "x", "type": kind, **({"baseSeverity": entry} if entry else {}), "cvssData": {k: v for k, v in (("baseScore", score), ("baseSeverity", severity)) if v is not None}}


def match(criteria, vulnerable=True):
    return {"vulnerable": vulnerable, "criteria": criteria}


ITEMS = [
    item("A", metrics={"cvssMetricV31": [metric("Secondary", 5.0), metric("Primary", 9.8)], "cvssMetricV30": [metric("Primary", 1.0)], "cvssMetricV2": [metric("Primary", 2.0)]}),
    item("B", metrics={"cvssMetricV31": [metric("Secondary", 4.0), metric("Secondary", 6.0)]}),
    item("C", metrics={"cvssMetricV31": [metric("Primary", None)], "cvssMetricV2": [metric("Primary", 2.0)]}),
    item("D", metrics={"cvssMetricV2": [metric("Primary", 7.5, None, "MEDIUM")]}),
    item("E", metrics={"cvssMetricV40": [metric("Primary", 7.5)]}),
    item("F", text=""),
    item(
        "G",
        configurations=[{"nodes": [{"cpeMatch": [match("cpe:2.3:a:big_co:tool:1.0:x"), match("cpe:2.3:o:big_co:tool:1.0:x"), match("cpe:2.3:a:co:tool:2", False), match("cpe:2.3:a:co"), match("cpe:2.3:a:*:tool:1:x")]}]}],
        weaknesses=[{"source": "s1", "type": "Primary", "description": [{"lang": "en", "value": "CWE-79"}, {"lang": "fr", "value": "non"}]}, {"source": "s2", "type": "Secondary", "description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-noinfo"}]}],
    ),
    item("H"),
]


@pytest.fixture()
def items(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, ITEMS)))
    return feeds.read_feed(spark, [str(tmp_path / "one.jsonl")])


def test_records_and_scores(items):
    got = {r["id"]: (r["score"], r["version"], r["severity"]) for r in feeds.flatten_records(items).collect()}
    assert got == {"A": (9.8, "v31", "HIGH"), "B": (4.0, "v31", "HIGH"), "C": (None, "v31", "HIGH"), "D": (7.5, "v2", "MEDIUM"), "E": (None, None, None), "G": (None, None, None), "H": (None, None, None)}


def test_children(items):
    assert [(r["part"], r["entity"], r["item"], r["version"]) for r in feeds.explode_affected(items).collect()] == [("a", "big co", "tool", "1.0")]
    assert {(r["label"], r["source"], r["generic"]) for r in feeds.explode_assignments(items).collect()} == {("CWE-79", "s1", False), ("CWE-79", "s2", False), ("NVD-CWE-noinfo", "s2", True)}


def test_wrapped_feed_and_restated_record(spark, tmp_path):
    weak = lambda *labels: [{"source": "s", "type": "Primary", "description": [{"lang": "en", "value": x} for x in labels]}]
    for name, one in (("a", item("X", weaknesses=weak("CWE-1", "CWE-2"))), ("b", item("X", weaknesses=weak("CWE-2")))):
        (tmp_path / f"{name}.json").write_text(json.dumps({"cve_items": [one]}))
    found = feeds.read_feed(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], layout="wrapped")
    assert [r["label"] for r in feeds.latest_state(feeds.explode_assignments(found), found).collect()] == ["CWE-2"]
    assert feeds.latest_records(feeds.flatten_records(found)).count() == 1


def test_catalog(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<Catalog><Weaknesses><Weakness ID="79" Name="XSS"><Description>Bad  <b>input</b>\n here</Description></Weakness></Weaknesses><Categories><Category ID="1" Name="Cat"><Summary>s</Summary></Category></Categories></Catalog>')
    got = {r["id"]: (r["name"], r["description"]) for r in feeds.read_label_catalog(spark, str(tmp_path / "c.xml")).collect()}
    assert got == {"CWE-79": ("XSS", "Bad input here"), "CWE-1": ("Cat", "")}


def test_csv_and_parquet_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a,c")], "year long, name string")
    tables.export_csv(df, str(tmp_path / "csv"), ["year"])
    assert [tuple(r) for r in tables.read_csv_table(spark, str(tmp_path / "csv"), "year long, name string").collect()] == [(1, "a,c"), (2, "b")]
    assert tables.materialize(df, str(tmp_path / "t"), ["year"]).where("year = 1").select("name").first()[0] == "a,c"


def test_upsert_children_replaces_as_a_whole(spark):
    base = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id long, label string")
    got = incremental.upsert_children(base, spark.createDataFrame([(1, "y")], "id long, label string"), spark.createDataFrame([(1,)], "id long"), "id")
    assert {tuple(r) for r in got.collect()} == {(1, "y"), (2, "z")}


def test_stream_equals_batch_and_replays(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "value")
    landing, target = str(tmp_path / "in"), str(tmp_path / "table")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(landing)
        incremental.stream_upsert(spark, landing, events.schema, target, "user_id", ["ts", "event_id"], str(tmp_path / "state")).awaitTermination()
    want = {tuple(r) for r in incremental.latest(events, "user_id", ["ts", "event_id"]).collect()}
    assert {tuple(r) for r in incremental.current(spark, target).select(*events.columns).collect()} == want
    incremental.stream_upsert(spark, landing, events.schema, target, "user_id", ["ts", "event_id"], str(tmp_path / "state2")).awaitTermination()
    assert {tuple(r) for r in incremental.current(spark, target).select(*events.columns).collect()} == want


def test_only_partitions_of_the_delta_are_rewritten(spark, tmp_path):
    """Files of the other years keep their names and times, and a join with few years reads these years alone."""
    path = str(tmp_path / "t")
    rows = lambda lo, hi: spark.range(lo, hi).select("id", (F.col("id") % 5 + 2000).cast("int").alias("year"))
    tables.materialize(rows(0, 100), path, ["year"])
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    tables.replace_partitions(rows(0, 50).where("year = 2002"), path, ["year"])
    after = files()
    assert {f for f in before if "year=2002" not in str(f)} == {f for f in before if after.get(f) == before[f]}
    assert {r["year"]: r["count"] for r in spark.read.parquet(path).groupBy("year").count().collect()} == {2000: 20, 2001: 20, 2002: 10, 2003: 20, 2004: 20}
    few = spark.createDataFrame([(2002, "a"), (2003, "b")], "year int, name string").where("name = 'a'")
    joined = spark.read.parquet(path).join(F.broadcast(few), "year")
    assert joined.count() == 10
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()

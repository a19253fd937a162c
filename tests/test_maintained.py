"""A stream of restated records keeps children, trends and edges as the batch operators count them."""

import glob
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.shared import shuffles_freed
from tidemark.operators import network as E
from tidemark.operators import trends as D
from tidemark.operators.labels import canonical_label
from tidemark.streaming import incremental
from tidemark.streaming.maintained import KEYS, Maintained, stream_tables

SCHEMA = "id long, date date, year long, score double, severity string, status string, modified long, assignments array<struct<label: string, source: string, type: string, generic: boolean>>, affected array<struct<entity: long, item: long, version: long>>"


def _version(rng, id, modified):
    labels = [(f"L{rng.randrange(6)}", rng.choice("NO"), rng.choice("OF"), False) for _ in range(rng.randrange(4))]
    labels += [("L-none", "N", "O", True)] if rng.random() < 0.1 else []
    items = [(rng.choice([None, 1, 2, 3]), rng.randrange(2), rng.randrange(3)) for _ in range(rng.randrange(4))]
    items += items[:1]
    score = rng.choice([None, 1.5, 4.25, 9.75])
    return (id, None, rng.choice([None, 1999, 2000, 2001]), score, rng.choice([None, "LOW", "HIGH"]), "s", modified, None if rng.random() < 0.1 else labels, None if rng.random() < 0.1 else items)


def _same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(key, got.select(columns).collect()), key=repr) == sorted(map(key, want.select(columns).collect()), key=repr)


def _hold(spark, target, versions):
    newest = {}
    for v in versions:
        if v[0] not in newest or v[6] > newest[v[0]][6]:
            newest[v[0]] = v
    rows = spark.createDataFrame(list(newest.values()), SCHEMA)
    records, asg, aff = rows.drop("assignments", "affected"), *(rows.select("id", F.explode(c).alias("c")).select("id", "c.*") for c in ("assignments", "affected"))
    canon, kept = canonical_label(asg, "N", "O"), Maintained(spark, target)
    _same(kept.records(), records)
    _same(kept.children("assignments"), asg)
    _same(kept.children("affected"), aff)
    _same(kept.entity_year_trend(), D.entity_year_trend(records, aff))
    _same(kept.severity_year_trend(), D.severity_year_trend(records))
    _same(kept.coverage_by_year(), D.coverage_by_year(records, aff, asg))
    _same(kept.label_year_trend().where("year IS NOT NULL"), D.label_year_trend(records, canon).where("year IS NOT NULL"))
    _same(kept.item_year_trend().where("year IS NOT NULL"), D.item_year_trend(records, aff).where("year IS NOT NULL"))
    _same(kept.counts("buckets").drop("n"), E.buckets(aff, records, canon))
    _same(kept.edges(), E.cooccurrence(E.buckets(aff, records, canon)))


@pytest.fixture(scope="module")
def deltas():
    """Restated, repeated and late versions in an order by chance; one batch restates what the one before it said."""
    rng = random.Random(5)
    versions = [_version(rng, i, m) for i in range(40) for m in range(1, 4)]
    rng.shuffle(versions)
    return [versions[:50], versions[40:55], versions[55:]]


def _stream(spark, tmp, k, state="state", rows=()):
    if rows:
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp / f"in{k}"))
    stream_tables(spark, str(tmp / f"in{k}"), SCHEMA, str(tmp / "kept"), ["modified"], str(tmp / f"{state}{k}"), authority="N", primary="O", buckets=4).awaitTermination()


def test_stream_keeps_trends_and_edges_of_any_order_of_deltas(spark, tmp_path, deltas):
    """Each landing folder has a checkpoint of its own, so generations go on over streams that start anew."""
    for k, rows in enumerate(deltas):
        _stream(spark, tmp_path, k, rows=rows)
    _stream(spark, tmp_path, 0, "again")  # everything of the first folder once more
    _hold(spark, str(tmp_path / "kept"), sum(deltas, []))
    names = incremental._names
    for name in ("records", *KEYS):
        lists = [n for n in names(spark, f"{tmp_path}/kept/{name}/_generations") if n.startswith("n")]
        assert len(lists) == 2  # not one per batch
        held = incremental._generations(spark, f"{tmp_path}/kept/{name}")
        assert {n for n in names(spark, f"{tmp_path}/kept/{name}") if n.startswith("g")} == {f"g{g}" for kept in held.values() for g, _ in kept}


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path, deltas):
    """As after a driver that was lost between the last write and the stream's commit."""
    _stream(spark, tmp_path, 0, rows=deltas[0])
    spark.createDataFrame(deltas[1], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in0"))
    _stream(spark, tmp_path, 0)
    (tmp_path / "state0" / "commits" / "1").unlink()
    (tmp_path / "state0" / "commits" / ".1.crc").unlink(missing_ok=True)
    _stream(spark, tmp_path, 0)
    _hold(spark, str(tmp_path / "kept"), deltas[0] + deltas[1])


def test_no_batch_yet_is_an_empty_table(spark, tmp_path):
    (tmp_path / "in0").mkdir()
    _stream(spark, tmp_path, 0)
    kept = Maintained(spark, str(tmp_path / "kept"))
    assert kept.records().count() == kept.edges().count() == kept.entity_year_trend().count() == 0


def test_all_rows_of_a_bucket_can_go(spark, tmp_path):
    add = lambda held, new: held.unionByName(new).groupBy("k").agg(F.sum("n").alias("n")).where("n <> 0")
    for generation, n in enumerate((1, -1, 2)):
        before, now = incremental.merge_generation(spark, str(tmp_path / "t"), generation, spark.createDataFrame([(7, n)], "k long, n long"), ["k"], 4, add)
        assert (before.count(), now.count()) == [(0, 1), (1, 0), (0, 1)][generation]


def test_restated_orders_are_joined_once(spark):
    """Both deltas and the stale versions in them joined and collected all child rows anew."""
    from tidemark.plans import source_queries
    from tidemark.plans.roles import Roles

    for part in source_queries._restated(Roles(spark, "/root/testdata/sf0.001")):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_a_bucket_is_the_work_of_many_tasks(spark):
    """Each bucket was gathered in one task, which grew with the table."""
    dealt = incremental.dealt_out(spark.range(4000), ["id"], 2).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = {(r["__bucket"], r["task"]) for r in dealt.select("__bucket", "task").distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(len({t for b, t in tasks if b == bucket}) > 1 for bucket in (0, 1))


def test_a_batch_tells_what_it_replaced_and_holds_no_table_in_memory(spark, tmp_path):
    """Late and repeated rows change nothing; whole rows were cached, three times a batch."""
    told, cached = [], []

    def changed(rows, generation):
        told.append(sorted((r["k"], r["v"], r["__sign"]) for r in rows.collect()))
        cached.append(spark._jsc.sc().getPersistentRDDs().size())

    for rows in ([(1, 1), (2, 5)], [(1, 2), (2, 3), (2, 5), (3, 1), (3, 4)]):
        spark.createDataFrame(rows, "k long, v long").write.mode("append").parquet(str(tmp_path / "in"))
        incremental.stream_upsert(spark, str(tmp_path / "in"), "k long, v long", str(tmp_path / "t"), "k", ["v"], str(tmp_path / "state"), buckets=2, changed=changed).awaitTermination()
    assert told == [[(1, 1, 1), (2, 5, 1)], [(1, 1, -1), (1, 2, 1), (3, 4, 1)]]
    assert cached == [0, 0]


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in folders for p in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    with shuffles_freed(spark):
        spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "t"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.read.parquet(str(tmp_path / "t")).count() == 1000

"""The neighbourhoods of all labels hold those of each label."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import neighbours as N
from tidemark.operators import network as E


def made(spark):
    """Buckets of six labels over nine years, one label alone, one only in early years."""
    rows = {(k % 5, k % 3, 2000 + k % 9, "abcdef"[(k * k + k // 7) % 6]) for k in range(200)} | {(99, 0, 2003, "alone")} | {(1, 1, y, "early") for y in (2000, 2001)}
    return spark.createDataFrame(sorted(rows), "entity long, item long, year long, label string")


def rows(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_all_labels_are_each_label(spark):
    found = made(spark).cache()
    pruned = E.prune_top_k(E.cooccurrence(found), 2)
    every = {
        "pairings": N.all_pairings(found), "summary": N.all_summaries(found), "partners": N.all_partners(found), "recent_shift": N.all_recent_shifts(found, 2), "drawn": N.all_drawn(found, pruned),
        "year_shares": N.all_year_shares(found, 2, 2), "hubs": N.all_hubs(found, 4),
    }
    every = {k: v.cache() for k, v in every.items()}
    drivers = N.all_drivers(found).cache()
    carriers = N.all_carriers(found)
    for label in ("a", "d", "alone", "early"):
        one = {"pairings": E.pairings(found, label), "summary": E.summary(found, label), "partners": E.partners(found, label), "recent_shift": E.recent_shift(found, label, 2), "drawn": E.drawn(found, label, pruned), "year_shares": E.year_shares(found, label, 2, 2), "hubs": E.hubs(found, label, 4)}
        for name, df in one.items():
            assert rows(every[name].where(F.col("label") == label), df.columns) == rows(df, df.columns), (name, label)
        assert rows(carriers.where(F.col("label") == label), ["year", "carriers"]) == rows(E.carriers(found, label).groupBy("year").count(), ["year", "count"])
        met = E.drivers(found, label, "b")
        assert rows(drivers.where((F.col("label") == label) & (F.col("partner") == "b")), met.columns) == rows(met, met.columns)


def test_no_buckets_no_neighbours(spark):
    none = made(spark).limit(0)
    assert N.all_summaries(none).collect() == N.all_partners(none).collect() == N.all_hubs(none).collect() == []

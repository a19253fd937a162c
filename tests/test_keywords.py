"""Searches of the trigram index against a scan of all texts."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import keywords
from tidemark.operators.search import has_words

ODD = [(1, None), (2, ""), (3, "ab"), (4, "ABC abd"), (4, "ABC abd"), (None, "the abc"), (5, "x" * 100_000 + "needle"), (6, "Straße \U0001f600\U0001f600\U0001f600 100% a_b"), (7, "of the"), (8, "İstanbul")]


def built(spark, rows, **more):
    path = tempfile.mkdtemp() + "/index"
    records = spark.createDataFrame(rows, "id long, text string").withColumns({"row": F.lit(1), "slot": F.lit("s"), **more})
    keywords.build_index(records, path)
    return records, path


@pytest.fixture(scope="module")
def odd(spark):
    return built(spark, ODD)


@pytest.mark.parametrize("words", ["abc", "ABD Abc", "ab", "", "  ", "needle", "xxxx", "straße", "\U0001f600\U0001f600\U0001f600", "100% a_b", "the of", "of", "none of these", "i̇sta"])
def test_odd_texts(spark, odd, words):
    records, path = odd
    want = sorted(map(str, records.where(has_words(F.col("text"), words)).collect()))
    assert sorted(map(str, keywords.search_index(spark, path, words).select(records.columns).collect())) == want


def test_blocks_of_any_size(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(30)))) for k in range(400)]
    for block in (1, 500, keywords.BLOCK):
        batch = [r for b in keywords._postings(_arrow(rows)) for r in b.to_pylist()] if block == keywords.BLOCK else _with_block(monkeypatch, block, rows)
        held = {}
        for r in batch:
            for o in r["offsets"]:
                assert (r["gram"], r["first"] + o) not in held
                held[r["gram"], r["first"] + o] = 1
        assert set(held) == {(g, k) for k, t in rows for g in keywords.trigrams(t).tolist()}


def _with_block(monkeypatch, block, rows):
    with monkeypatch.context() as m:
        m.setattr(keywords, "BLOCK", block)
        return [r for b in keywords._postings(_arrow(rows)) for r in b.to_pylist()]


def _arrow(rows):
    import pyarrow as pa

    for at in range(0, len(rows), 150):
        part = rows[at : at + 150]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([t for _, t in part])], names=["row", "text"])


def _files_read(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_a_search_reads_few_files(spark):
    """A word that one text of 3,000 has: few of the postings' files and one folder of the texts are read."""
    rng = random.Random(7)
    rows = [(k, " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40))) for k in range(3000)]
    rows[1234] = (1234, rows[1234][1] + " quaxotl")
    records, path = built(spark, rows)
    grams = keywords.wanted("Quaxotl").tolist()
    everything = spark.read.parquet(f"{path}/postings").select("gram")
    assert 4 * _files_read(keywords.postings_of(spark, path, grams[:8])) < _files_read(everything)
    found = keywords.search_index(spark, path, "Quaxotl")
    assert [r["id"] for r in found.collect()] == [1234]
    assert f"{keywords.FOLDER}" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_an_empty_table(spark):
    _, path = built(spark, [])
    for words in ("abc", "ab", ""):
        assert keywords.search_index(spark, path, words).count() == 0

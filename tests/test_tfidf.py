"""TF-IDF in chunks and parts against the plain join of counts with the vocabulary."""

import os
import random

from pyspark.sql import functions as F

from tidemark.functions.shared import shared_folder
from tidemark.operators import textclusters
from tidemark.operators import text as G
from tidemark.operators.tfidf import pack_groups, weigh_groups


def _plain(docs, min_df, max_df, min_docs):
    sizes = docs.groupBy("grp").agg(F.count_distinct("id").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    counts = G.terms(docs.join(sizes.select("grp"), "grp", "left_semi"))
    return G.weigh(counts, G.vocabulary(counts, sizes, min_df, max_df))


def _rows(df):
    return {(r["grp"], r["id"], r["term"]): r["w"] for r in df.collect()}


def _docs(spark):
    rng, words = random.Random(3), [f"w{k}" for k in range(40)] + ["the", "x", "é", "naïve"]
    rows = [(f"g{k % 3}", k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [("g0", 1000, None), ("g0", 1001, ""), ("g1", 1002, "one"), ("g1", 1003, "the the"), ("few", 1004, "w1 w2"), (None, 1005, "w1 w2"), ("void", 1006, None), ("void", 1007, "")]
    return spark.createDataFrame(rows, "grp string, id long, cleaned string")


def test_equal_to_the_join_for_any_size_of_chunks(spark):
    docs = _docs(spark)
    want = _rows(_plain(docs, 3, 0.5, 2))
    assert len(want) > 3000 and any(" " in t for _, _, t in want)
    for chars in (300, 5000, 1 << 23):
        got = _rows(weigh_groups(docs, 3, 0.5, 2, "cleaned", G.STOP_WORDS, chars))
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert not _rows(G.tfidf(docs.limit(0)))


def test_cleaned_once_and_no_row_per_term_before_the_weights(spark):
    """Before, rows of single terms were written, read twice and shuffled twice; only arrays move now."""
    plan = G.tfidf(_docs(spark), min_docs=2)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "Generate" not in plan


def test_clean_text_takes_runs_with_a_letter(spark):
    odd = ["See HTTPS://a.b/c?d now", "CVE-2020-12345 fixed in 1.2.3 and v1.2", "  ", "", None, "12 345 6a a6 ７x", "tab\tx\x0by z", "9" * 5000 + "a " + "7" * 5000, "don't stop-me", "www.x.y z"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").orderBy("k").select(G.clean_text(F.col("t"))).collect()]
    assert got == ["see now", "fixed in and v1", "", "", None, "6a a6 x", "tab x y z", "9" * 5000 + "a", "don t stop me", "z"]


def test_packed_weights_give_what_rows_give(spark):
    docs = _docs(spark)
    rows = _plain(docs, 3, 0.5, 2).persist()
    given = docs.where("grp is not null").select("grp", "id", (F.col("id") % 4).alias("cluster")).join(rows.select("grp", "id").distinct(), ["grp", "id"])
    for chars, part_chars in ((5000, 900), (1 << 21, 1 << 21)):
        packed = pack_groups(docs, 3, 0.5, 2, "cleaned", G.STOP_WORDS, chars, part_chars)
        assert sorted(map(tuple, textclusters.weighed(packed).collect())) == sorted(map(tuple, rows.select("grp", "id").distinct().collect()))
        for f in (textclusters.cohesion, textclusters.cluster_terms, textclusters.silhouette):
            want, got = ({tuple(r[:2]) if f is not textclusters.silhouette else r[0]: r[-1] for r in f(w, given).collect()} for w in (rows, packed))
            assert want and got.keys() == want.keys()
            assert all(got[k] == want[k] if isinstance(want[k], str) else abs(got[k] - want[k]) < 1e-9 for k in want)
        clusters = [{tuple(r[:2]): r[2] for r in textclusters.cluster_docs(w, starts=2, rounds=30).collect()} for w in (rows, packed)]
        assert clusters[0] == clusters[1] and len(set(clusters[0].values())) > 5


def test_centroids_of_packed_weights_need_no_row_per_term(spark):
    """Before, cohesion and terms of clusters shuffled a row per term of a document."""
    docs = _docs(spark)
    packed = pack_groups(docs, 3, 0.5, 2, "cleaned", G.STOP_WORDS)
    plan = textclusters.cohesion(packed, docs.select("grp", "id", F.lit(1).alias("cluster")))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate" not in plan and "term" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_only_weights_and_terms_stay_on_the_shared_folder(spark):
    """Texts and the chunks' places in the vocabulary stayed beside them."""
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    packed = pack_groups(_docs(spark), 3, 0.5, 2, "cleaned", G.STOP_WORDS)
    assert sorted(name.split("-")[0] for name in set(os.listdir(folder)) - before) == ["packed", "terms"]
    assert packed.vocabulary.count() and packed.matrix.count()

"""The near-duplicate stage against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from tidemark.llm import jaccard, simhash
from tidemark.llm.common import table
from tests.llm.test_text_operators import docs

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "one"), (4, "one"), (None, "no id"), (3, "word " * 30_000), (7, "123 456"), (8, " \n\t")]


def shingle_set(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def survivors(rows):
    """Smallest ids of the components of all pairs with similarity 0.8 or more, and how many such pairs are not equal."""
    sets, holders = [shingle_set(t) for _, t in rows], {}
    top, near = list(range(len(rows))), 0

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, s in enumerate(sets):
        both = {}
        for x in s:
            for j in holders.setdefault(x, []):
                both[j] = both.get(j, 0) + 1
            holders[x].append(i)
        for j, n in both.items():
            union = len(s) + len(sets[j]) - n
            if 5 * n >= 4 * union:
                near += n < union
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {rows[find(i)][0] for i in range(len(rows))}, near


def test_stage_drops_all_copies_of_jaccard_similarity(spark):
    long = table(spark, SF, "documents").where("size(split(trim(text), '\\\\s+')) >= 50").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in long.collect())
    want, near = survivors(rows)
    assert near >= 10
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, long, SF).collect()}
    assert got == want


def test_similarity_around_the_limit(spark):
    """Copies of a text of 200 words with one to twelve words changed: similarity 0.95 to 0.55."""
    rng, rows = random.Random(4), []
    for k in range(120):
        base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        other = list(base)
        for at in rng.sample(range(200), 1 + k % 12):
            other[at] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want, near = survivors(rows)
    assert 30 < near < 110
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), SF).collect()} == want


def test_chains_and_large_groups_of_copies():
    rng = np.random.default_rng(1)
    chain = [np.arange(10 * k, 10 * k + 100, dtype=np.uint64) for k in range(60)]  # 90 of 110 shared by neighbours only
    group = [np.unique(np.concatenate([np.arange(5000, 5100), rng.integers(6000, 2**60, 10)])).astype(np.uint64) for _ in range(200)]
    sets = [*chain, *group, np.arange(5000, 5060, dtype=np.uint64)]
    assert jaccard.linked(sets) == [0] * 60 + [60] * 200 + [260]


def test_odd_rows(spark):
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs(spark, ODD)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 3), (None, None), (3, 3), (7, 7), (8, 1)], key=str)
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_index_proposes_all_within_its_bits(spark):
    """The pipeline's stage goes through operator 5's index: any two classes within 4 bits are connected, whatever their bands."""
    rng, rows = random.Random(9), []
    for k in range(60):
        base = rng.getrandbits(64)
        rows += [(4 * k + j, base ^ sum(1 << b for b in rng.sample(range(64), j))) for j in range(4)] + [(1000 + k, base)]
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in rows], "rep long, fp long")
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in jaccard.alike(frame).collect():
        a, b = find(r["a"]), find(r["b"])
        top[max(a, b)] = min(a, b)
    assert [find(i) for i, _ in rows] == [4 * (k // 5) for k in range(300)]


def test_signatures_hold_operator_5s_fingerprint(spark):
    for text in (None, "", "one", "A b c d e f", "a b c d e a b c d e a b c d e f"):
        assert simhash.fingerprint(jaccard.hashes(text, 5)) == simhash.simhash(text, 5)

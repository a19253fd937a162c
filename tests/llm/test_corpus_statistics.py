"""Resampling, the filter audit and the language model against plain re-implementations and odd tables."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, language_model, resampling
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "one"), (4, "one"), (None, "no id"), (None, "no id"), (3, "Word word " * 30_000), (3, "Word word " * 30_000), (7, "123 456"), (8, " \n\t"), (9, "é1é ÀB x\0y \x85 z"), (-5, "x" * 70_000)]


def frame(spark, rows, extra="lang"):
    return spark.createDataFrame([(i, t, "en" if k % 3 else None) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, {extra} string")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_resample(rows, target, n_gram=1, buckets=10_000, min_words=20, percent=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    grams = lambda w: [" ".join(w[k : k + n]) for n in range(1, n_gram + 1) for k in range(len(w) - n + 1)]
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in grams(words(text))) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        fs = grams(words(text))
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, fs)) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return [tuple(r[:1] + r[2:]) for r in out]


@pytest.mark.parametrize("n_gram", [1, 3])
def test_resampling_is_that_of_plain_counts(spark, n_gram, monkeypatch):
    monkeypatch.setattr(resampling, "WORDS_AT_ONCE", 97)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()] + ODD
    target = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    got = resampling.resample(frame(spark, rows), table(spark, SF, "benchmark"), n_gram=n_gram, percent=30)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == Counter(brute_resample(rows, target, n_gram, percent=30))


def test_pieces_of_a_batch_cut_no_feature(monkeypatch):
    texts = ["a b c d", None, "e", "", "f g h"]
    whole = [(o.tolist(), f.tolist(), b.tolist()) for o, f, b in resampling.features(texts, resampling._Hashes(), 3)]
    monkeypatch.setattr(resampling, "WORDS_AT_ONCE", 2)
    pieces = [(o.tolist(), f.tolist(), b.tolist()) for o, f, b in resampling.features(texts, resampling._Hashes(), 3)]
    assert len(pieces) > len(whole) == 1
    assert Counter(x for _, f, b in whole for x in zip(f, b)) == Counter(x for _, f, b in pieces for x in zip(f, b))
    assert [x for o, _, _ in pieces for x in o] == whole[0][0]


def test_resampling_of_odd_tables(spark):
    empty = frame(spark, ODD).limit(0)
    assert resampling.resample(empty, empty).collect() == []
    assert {r["rank"] for r in resampling.resample(frame(spark, ODD), empty).collect()} == {None}
    odd = frame(spark, ODD, "Rank").withColumn("fits", F.lit(1)).withColumn("place", F.lit(2)).withColumn("a.b", F.lit(3))
    got = resampling.resample(odd, empty, percent=100, min_words=0).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(ODD) + 1))
    assert {(r["fits"], r["place"], r["a.b"]) for r in got} == {(1, 2, 3)}


def brute_audit(rows, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        good[i], toxic[i] = max(good[i], int(q == 1)), max(toxic[i], int(t == 1))
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        docs.append((lang or "", {k for k, v in f.items() if v}, good[i], toxic[i]))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(x in d[1] for d in mine) - len(gone) - sum(x in d[1] for d in left), sum(d[1] == {x} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audit(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.fold_orders(filter_audit.mask_cells(docs, labels)).collect()}


def test_audit_is_that_of_applying_the_filters(spark):
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (4, 1, None), (None, 1, 1), (7, 0, 1)] + [(k, k % 2, k % 3 == 0) for k in range(20, 60)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    texts = ["alpha beta gamma " * 50, " ".join(f"w{k}" for k in range(150)), "UPPER " * 120, "a|b " + " ".join(f"v{k}" for k in range(120)), None]
    rows = [(i, t, "en" if k % 3 else None) for k, (i, t) in enumerate(ODD)] + [(20 + k % 40, texts[k * 7 % 5], [None, "", "fr", "de"][k % 4]) for k in range(90)]
    frames = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    # a row without an id has no label, though labels may have rows without one
    assert audit(*frames) == brute_audit(rows, [x for x in labels if x[0] is not None])


def test_audit_of_an_empty_table_has_no_parts(spark):
    none = table(spark, SF, "documents").limit(0)
    assert audit(none, table(spark, SF, "labels")) == {}
    some = audit(table(spark, SF, "documents"), table(spark, SF, "labels").limit(0))
    assert len(some) % 600 == 0 and sum(x[4] + x[5] for x in some.values()) == 0


def test_audit_broadcasts_nothing_whatever_the_files_of_the_labels_weigh(spark):
    """Labels are small in their files, eight times as many rows in the join: the driver would have to hold them all."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert "BroadcastExchange" not in filter_audit.mask_cells(docs, labels)._jdf.queryExecution().executedPlan().toString()


def brute_base(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + ["\n"] for _, t in rows]
    held = [i is not None and crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    N, V = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), N, sum(math.log10((c[w] + 0.5) / (N + 0.5 * (V + 1))) for w in ws)) for (i, _), ws, h in zip(rows, tokens, held)]


@pytest.mark.parametrize("shared", [1 << 20, 50])
def test_base_scores_are_those_of_plain_counts(spark, shared, monkeypatch):
    """With few shared words most counts come from the join."""
    monkeypatch.setattr(language_model, "SHARED", shared)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()] + ODD
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted((tuple(r) for r in language_model.language_model_scores(frame(spark, rows)).collect()), key=key)
    want = sorted(brute_base(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    held = [g for g in got if g[1]]
    assert all(g[6] < 0 for g in got) and sum(g[6] for g in held) > sum(g[5] for g in held)  # better than counts on what it has not seen


def test_probabilities_of_all_words_add_up_to_one(spark):
    """After any context the known words and one unseen word of each bucket have the whole probability."""
    rows = [(k, t) for k, t in enumerate(["the cat sat on the mat", "a dog ate the cat", "rain fell on a dog"] * 4)]
    docs = frame(spark, rows).select("doc_id", "text", F.lit(False).alias("held"), F.col("doc_id").alias("part"))
    words = language_model.count_words(docs).cache()
    counts = language_model.gather(docs, words)
    model = language_model.train(docs, counts)
    known = [r["word"] for r in words.collect()]
    endings = {}
    for a in "abcdefghijklmnopqrstuvwxyz0123456789":
        for b in "abcdefghijklmnopqrstuvwxyz0123456789":
            endings.setdefault(crc32((a + b).encode()) % language_model.TAILS, "unseen" + a + b)
    assert len(endings) == language_model.TAILS
    total = 0.0
    probe = frame(spark, [(k, w) for k, w in enumerate([*known, *endings.values()])]).select("doc_id", "text", F.lit(True).alias("held"))
    # a text's first word given the start: the probability of (word, end) over that of the end after the word
    after = {}
    for r in language_model.score(probe, counts, words, model).collect():
        after[r["doc_id"]] = r["score"]
    listed = language_model.Words([*known, *endings.values()])
    row, _ = listed.sequence(listed.symbols(counts.frequent))
    lp = model.log_probabilities(row)
    ends = lp[[k for k, s in enumerate(row[language_model.CONTEXT :]) if s == language_model.END]] / math.log(10)
    for k in after:
        total += 10 ** (after[k] - ends[k])
    start = np.full(language_model.CONTEXT + 1, language_model.START)
    start[-1] = language_model.END
    total += math.exp(model.log_probabilities(start)[0])
    assert total == pytest.approx(1, abs=1e-4)


def test_factors_agree_with_scores_of_whole_vectors():
    rng = np.random.default_rng(2)
    for scale in (0.3, 6.0):  # the larger one makes sums that floats cannot hold
        m = language_model.Model.fresh(np.full(language_model.SYMBOLS, 1 / language_model.SYMBOLS))
        m.context, m.target = ((x * scale / 0.3).astype("f4") for x in (m.context, m.target))
        row = rng.integers(0, language_model.SYMBOLS, 400).astype(np.int32)
        _, q = m.predict(row)
        s = (q @ m.target.T + m.bias).astype("f8")
        want = s[np.arange(len(s)), row[language_model.CONTEXT :]] - s.max(1) - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1))
        assert np.allclose(m.log_probabilities(row), want, atol=1e-2 if scale > 1 else 1e-4)


def test_language_model_of_an_empty_table(spark):
    assert language_model.language_model_scores(frame(spark, ODD).limit(0)).collect() == []
    untrained = language_model.language_model_scores(frame(spark, [(i, "some words") for i in range(60) if crc32(str(i).encode()) % 5 == 1])).collect()
    assert untrained and {(r["n_known"], r["train_tokens"]) for r in untrained} == {(0, 0)}
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in untrained)


def test_words_end_alike_in_spark_and_in_tasks(spark):
    words = ["a", "ab", "abc", "é", "naïé", "日本語", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(language_model.tail_of(F.col("w"))).collect()
    assert [r[0] for r in got] == [crc32(w[-2:].encode()) % language_model.TAILS for w in words]

"""Near-duplicates, packing, quality, language and the pipeline."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import language, packing, pii, quality_classifier, quality_rules, simhash, weak
from tidemark.llm.common import table
from tests.llm.test_text_operators import docs

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "one"), (4, "one"), (None, "no id"), (3, "word " * 30_000), (7, "123 456"), (8, " \n\t")]


def brute_components(rows, bits=4):
    prints = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return prints, groups(np.array(prints, np.uint64), bits)


def groups(fps, bits):
    parent = list(range(len(fps)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= bits):
            a, b = top(i), top(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_simhash_components_are_those_of_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").where("doc_id < 400").orderBy("doc_id").collect()]
    prints, top = brute_components(rows)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    smallest = {}
    for (i, _), g in zip(rows, top):
        smallest[g] = min(i, smallest.get(g, i))
    for (i, _), p, g in zip(rows, prints, top):
        assert (got[i]["simhash"] % 2**64, got[i]["component_id"]) == (p, smallest[g])


@pytest.mark.parametrize("group", [20_000, 40, 7])
def test_dense_groups_lose_no_link(spark, group):
    rng = np.random.default_rng(3)
    one = np.uint64(1)
    fps = [rng.integers(0, 2**63, 300, dtype=np.uint64)]
    for center in rng.integers(0, 2**63, 3, dtype=np.uint64):
        flips = np.bitwise_or.reduce(np.left_shift(one, rng.integers(0, 64, (80, 4), dtype=np.uint64)), axis=1)
        fps.append(center ^ flips)
    fps = np.unique(np.concatenate(fps))
    frame = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64), "rep": np.arange(len(fps))}))
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(frame, group=group)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == groups(fps, 4)


def test_masks_cover_every_pair_within_the_limit():
    chosen, rng = simhash.masks(4, 6), random.Random(1)
    assert len(chosen) == 15
    for _ in range(500):
        flip = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flip & m == 0 for m in chosen)


def test_odd_rows_of_simhash(spark):
    got = simhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["simhash"] == 0} == {1}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(150):
        counts = {rng.randint(1, 40): rng.randint(1, 20) for _ in range(rng.randint(1, 8))}
        k, lengths = rng.randint(1, 4), sorted(counts)
        cost = lambda edges: sum(n * (min(b for b in edges if b >= x) - x) for x, n in counts.items())  # noqa: E731, B023
        best = min(cost([*e, lengths[-1]]) for size in range(min(k, len(lengths))) for e in itertools.combinations(lengths[:-1], size))
        got = packing.boundaries(counts, k)
        assert len(got) <= k and cost(got) == best
    assert packing.boundaries({}, 3) == []


def test_packing_keeps_every_token(spark):
    rng = random.Random(5)
    lengths = {i: rng.choice([0, 1, 7, 100, 513, 5000]) + rng.randint(0, 30) for i in range(500)}
    rows = spark.createDataFrame([*lengths.items(), (900, None), (None, 5)], "doc_id long, length long").withColumn("bucket", F.lit("clash"))
    got = packing.pack(rows, max_length=512, budget=2048, buckets=5, shard=100).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
        assert r["length"] <= r["bucket"] <= 512 and r["start"] == 512 * r["part"]
    assert total == Counter(lengths | {900: 0, None: 5})
    for _, batch in itertools.groupby(sorted(got, key=lambda r: r["batch"]), key=lambda r: r["batch"]):
        batch = list(batch)
        assert len({r["bucket"] for r in batch}) == 1 and sum(r["bucket"] for r in batch) <= 2048
        assert sorted(r["slot"] for r in batch) == list(range(len(batch)))
    assert packing.pack(rows.limit(0)).count() == 0


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(spark):
    frame = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in quality_rules.quality(frame, quality_rules.references(frame)).collect()}
    for r in rows.values():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(r["text"])
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    judged = [(rows[i]["kept"], q) for i, q in labels.items() if not rows[i]["base_failed"]]
    assert sum(kept == (q == 1) for kept, q in judged) >= 0.98 * len(judged)


def brute_references(rows, keep, common):
    """Class and word counts by plain Python: {lang: (chars, [(word, n)], words in all)}."""
    out = {}
    for t, l in rows:
        words = (t or "").encode().split()
        if len(words) < 50 or not keep(t):
            continue
        chars, found, total = out.setdefault(l, (np.zeros(len(quality_rules.CLASSES), int), Counter(), []))
        chars += quality_rules.char_histogram(t.encode())
        total.append(len(words))
        found.update(b for w in words if (b := w.decode().strip(quality_rules._EDGES).lower()))
    return {l: (chars, sorted(found.items(), key=lambda x: (-x[1], x[0]))[:common], sum(total)) for l, (chars, found, total) in out.items()}


def brute_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(*a) if x)
    return max(0.0, (half((p, q)) + half((q, p))) / 2) ** 0.5


@pytest.mark.parametrize("candidates", [200, 30])  # with 30 the second round counts all words
def test_quality_verdict_is_that_of_brute_force(spark, candidates):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, SF, "documents").where("doc_id < 250 AND lang != 'es'").collect()]
    rows += [(1000, None, None), (1001, "naïve Straße " * 60, None), (1002, "x" * 400 + " " + "internationalisation " * 99, "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def judge(known, t):
        words, parts = (t or "").encode().split(), []
        bare = Counter(w.decode().strip(quality_rules._EDGES).lower() for w in words)
        for chars, top, total in known.values():
            n = [*(bare[w] for w, _ in top), len(words) - sum(bare[w] for w, _ in top)]
            ref = [*(k for _, k in top), total - sum(k for _, k in top)]
            c, w = brute_distance(quality_rules.char_histogram(t.encode()), chars), brute_distance(n, ref)
            parts.append((max(c / 0.16, w / quality_rules.Reference(chars, [], np.array(ref)).allowed(np.array([len(words)]), 0.10)[0]), c, w))
        return min(parts)

    once = brute_references([(t, l) for _, t, l in rows], lambda t: True, quality_rules.COMMON)
    twice = brute_references([(t, l) for _, t, l in rows], lambda t: judge(once, t)[0] <= 1, quality_rules.COMMON)
    known = quality_rules.references(frame, candidates=candidates)
    assert {l: (r.chars.tolist(), list(zip(r.words, r.counts.tolist())), r.counts.sum()) for l, r in known.items()} == {l: (c.tolist(), top, n) for l, (c, top, n) in twice.items()}
    assert any(len(w) > 4 for r in known.values() for w in r.words)
    for r in quality_rules.quality(frame, known).collect():
        *_, failed = brute_quality(r["text"])
        if not failed:
            part, c, w = judge(twice, r["text"])
            assert abs(r["char_distance"] - c) < 1e-6 and abs(r["word_distance"] - w) < 1e-6
        assert r["kept"] == (not failed and part <= 1)


def test_short_texts_without_common_words_fail(spark):
    frame, rng = table(spark, SF, "documents"), random.Random(1)
    junk = [(n * 100 + k, " ".join("".join(rng.choice("bcdfghjkmpqvwxz") for _ in range(rng.randint(3, 9))) for _ in range(n))) for n in (50, 60, 90, 200) for k in range(20)]
    got = quality_rules.quality(docs(spark, junk), quality_rules.references(frame)).collect()
    assert not any(r["kept"] or r["base_failed"] for r in got)


def test_odd_rows_of_quality_rules(spark):
    frame = docs(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    got = quality_rules.quality(frame, quality_rules.references(frame)).collect()
    assert [r["n_words"] for r in got] == [0, 0, 1, 1, 2, 30_000, 2, 0] and not any(r["kept"] for r in got)
    assert quality_rules.quality(frame.limit(0), quality_rules.references(frame.limit(0))).count() == 0


def test_js_distance():
    p = np.array([[1, 1, 0], [0, 0, 5], [2, 2, 0], [0, 0, 0]])
    assert np.allclose(quality_rules.js_distances(p, np.array([3, 3, 0])), [0, 1, 0, 1])


def test_weak_labels_find_the_reliable_labelers():
    rng, rates, counts = random.Random(9), (0.95, 0.9, 0.85, 0.55), Counter()
    for _ in range(4000):
        truth = rng.random() < 0.6
        counts[tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < r) == truth else -1) for r in rates)] += 1
    share, found, posterior = weak.estimate(counts, 4)
    assert abs(share - 0.6) < 0.05 and abs(found[0, 1, 1] - 0.95) < 0.05 and found[3, 1, 1] < 0.7
    assert posterior[1, 1, 1, 0] > 0.95 and weak.estimate({}, 4)[0] == 0.5


def test_quality_classifier_agrees_with_labels(spark):
    frame = table(spark, SF, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(frame, quality_classifier.fit(frame)).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert sum(got[i] == (q == 1) for i, q in labels.items()) >= 0.97 * len(labels)


def test_odd_rows_of_the_quality_classifier(spark):
    frame = docs(spark, ODD)
    got = quality_classifier.classify(frame, quality_classifier.fit(frame)).collect()
    assert len(got) == len(ODD) and not got[0]["kept"] and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.classify(frame.limit(0), quality_classifier.fit(frame.limit(0))).count() == 0


def test_language_on_held_out_documents(spark):
    frame = table(spark, SF, "documents")
    got = language.identify(frame, language.fit(frame)).where(language.held_out(F.col("doc_id"))).collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_odd_rows_of_language(spark):
    frame = docs(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in language.identify(frame, language.fit(frame)).collect())
    model = language.fit(docs(spark, [(0, "eins zwei"), (1, "un deux")]).withColumn("lang", F.lit("xx")))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs(spark, ODD), model).collect()}
    assert got[1] == got[2] == got[7] == got[8] == "und" and got[4] == "xx"


def test_families_merge_the_most_alike():
    rng = np.random.default_rng(0)
    a, b = rng.random(50), rng.random(50)
    means = {"a1": a, "a2": a + 0.01 * rng.random(50), "b1": b, "b2": b + 0.01 * rng.random(50)}
    assert language.families_of(means) == [["a1", "a2"], ["b1", "b2"]]


def test_lengths_are_those_of_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, rows = Tokenizer.from_file(path), ODD + [(20, "It's ÉTÉ!! 23 漢字 <|endoftext|> a\u0301"), (21, "x" * 9999)]
    got = packing.with_length(docs(spark, rows), path).collect()
    assert [r["length"] for r in got] == [1 + len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]


def test_pipeline_stages_take_effect(spark):
    kept, ids = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).persist()
        assert kept.columns == before.columns
        assert kept.count() <= before.count()
        ids.append({r["doc_id"] for r in kept.select("doc_id").collect()})
    assert ids[0] > ids[1] > ids[2] == ids[3]  # test_jaccard.py holds the third stage against brute force
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert not any(labels.get(i) == 0 for i in ids[-1])
    text = " ".join(r["text"] for r in kept.collect())
    assert not re.search(r"[a-z0-9.]+@mail\d\.example\.com", text) and "password=1" not in text
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == ids[-1]


def test_stages_hand_on_columns_of_any_name(spark):
    own = {c: F.lit("mine") for c in ("score", "lang_pred", "Score_", "kept", "rule_kept", "n_words", "spans", "keep", "redacted", "component_id", "a.b", "c`d")}
    rows = table(spark, SF, "documents").where("doc_id < 200")
    frame = rows.select("*", *[v.alias(k) for k, v in own.items()])
    plain = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, frame = stage(spark, plain, SF), stage(spark, frame, SF)
        assert frame.columns == [*plain.columns, *own]
        got = frame.collect()
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in plain.select("doc_id").collect()} and got
        assert all(r[k] == "mine" for r in got for k in own)


def test_odd_tables_pass_all_stages(spark):
    rows = [(i, t, "en", "s", 1) for i, t in ODD] + [(k, "the cat of the house and the dog " * 20, None, None, None) for k in (50, 50, 51)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table_ in (frame, frame.limit(0)):
        kept = table_
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, SF)
            kept.count()


def test_letters_are_those_of_category_l():
    assert not any(language.has_letter(t) for t in ("½ ² ① Ⅷ 3_4", "", None, "\u0301"))
    assert all(language.has_letter(t) for t in ("½a", "ª", "漢", "ǅ", "12 é"))


def test_training_draws_are_bounded(spark):
    """Nine rows in ten share an id, a text or both."""
    rows = [(7 if k % 10 else k, "the same line of text" if k % 10 < 5 else f"text number {k} of the lot with mail a{k}@b.com") for k in range(4000)] + [(None, f"null {k}") for k in range(500)]
    frame = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    brought = []
    real = language.LanguageModel.fit, quality_classifier.train, pii.train
    try:
        language.LanguageModel.fit = classmethod(lambda cls, x, l: brought.append(len(x)) or cls())
        language.fit(frame, sample=100, per_language=60)
        quality_classifier.train = lambda x, y: brought.append(len(x)) or real[1](x[:0], y[:0])
        quality_classifier.fit(frame, sample=50)
        pii.train = lambda r: brought.append(len(r)) or real[2](r)
        pii.fit(frame, sample=40)
    finally:
        language.LanguageModel.fit, quality_classifier.train, pii.train = classmethod(real[0].__func__), real[1], real[2]
    assert 0 < brought[0] <= 60 and 0 < brought[1] <= 50 and 0 < brought[2] <= 40


def test_predictions_never_see_other_columns(spark):
    frame = table(spark, SF, "documents").where("doc_id < 300")
    model = language.fit(frame)
    mixed = frame.select("text", (F.col("doc_id") + 1000).alias("doc_id"), F.lit("fr").alias("lang"), F.lit("x").alias("source"))
    score = lambda f: sorted((r["text"] or "", r["lang_pred"], r["score"]) for r in language.identify(f, model).collect())
    assert score(frame) == score(mixed)
    learned = language.fit(frame.withColumn("text", F.when(language.held_out(F.col("doc_id")), "a b c").otherwise(F.col("text"))))
    assert all((learned.pair_weights[k] == v).all() for k, v in model.pair_weights.items())  # held-out texts teach nothing


def test_svm_reaches_the_least_objective():
    """Against projected gradient ascent on the dual over a small problem."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1, -1)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    objective = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    q, a = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(60)
    for _ in range(20_000):
        a = np.clip(a + (1 - q @ a) / np.linalg.norm(q, 2), 0, cost)
    best, got = objective((a * y) @ x), objective(language.train_svm(x, y, c=1.0, epochs=300))
    assert got <= best * 1.01 + 1e-3


def test_weak_labels_are_those_of_plain_em():
    """The same model over single items instead of counts of patterns, written out."""
    rng, items = random.Random(2), []
    for _ in range(300):
        truth = rng.random() < 0.5
        items.append(tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < r) == truth else -1) for r in (0.9, 0.8, 0.7)))
    post = [1 / (1 + np.exp(-2.0 * sum(v))) for v in items]
    for _ in range(200):
        rates = {}
        for k in range(3):
            cast = sum(v[k] != 0 for v in items)
            for c in (0, 1):
                n = [sum((p if c else 1 - p) for v, p in zip(items, post) if v[k] == s) for s in (-1, 1)]
                n = [x + weak.PRIOR * cast * (0.8 if (s == 1) == (c == 1) else 0.2) + 0.1 for x, s in zip(n, (-1, 1))]
                rates[k, c] = {-1: n[0] / sum(n), 1: n[1] / sum(n)}
        new = [1 / (1 + np.exp(-sum(np.log(rates[k, 1][x] / rates[k, 0][x]) for k, x in enumerate(v) if x))) for v in items]
        rested, post = max(abs(a - b) for a, b in zip(new, post)) < 1e-6, new
        if rested:
            break
    _, _, got = weak.estimate(Counter(items), 3, balance=0.5)
    assert all(abs(got[v] - p) < 1e-4 for v, p in zip(items, post))


def test_votes_and_measures_by_hand():
    text = "The cat sat. The cat sat.\nThe cat sat. The cat sat.\n" + "word!! " * 4 + "A|B #x"
    m, w = quality_classifier.measures(text.encode()), text.split()
    assert m["words"] == len(w) and abs(m["lines"] - 1 / 3) < 1e-12 and m["runs"] == 4 / len(w)
    assert m["adjacent"] == sum(a == b for a, b in zip(w, w[1:])) / len(w)
    windows = list(zip(w, w[1:], w[2:]))
    assert abs(m["windows"] - (1 - len(set(windows)) / len(windows))) < 1e-12
    assert m["symbols"] == 1 / len(text) and m["bars"] == 1 / len(w)
    assert m["ends"] == sum(x.endswith((".", "?", "!", '."')) for x in w) / len(w)
    assert quality_classifier.votes(quality_classifier.measures(b""))[:2] == (1, 1)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(600)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(chain).collect()}
    assert got == {k: 0 for k in range(601)} | {1000: 1000, 1001: 1000}


def test_the_language_stage_rejects_what_is_no_known_language(spark):
    rng, known = random.Random(3), table(spark, SF, "documents")
    junk = ["".join(rng.choice("абвгдежзийклмнопрст ") for _ in range(600)) for _ in range(20)] + [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(150)) for _ in range(20)] + ["123 456", "", None]
    mixed = known.where("lang = 'de'").limit(20).join(known.where("lang = 'en'").select(F.col("doc_id").alias("k"), F.col("text").alias("t")).limit(20), F.lit(True)).limit(20).withColumn("doc_id", F.col("doc_id") + 20_000).withColumn("text", F.concat("text", F.lit(" "), "t")).drop("k", "t")
    strange = spark.createDataFrame([(10_000 + k, t, None, "s", 1) for k, t in enumerate(junk)], known.schema)
    got = corpus_pipeline.identify_language(spark, known.unionByName(strange).unionByName(mixed), SF)
    ids = Counter(r["doc_id"] // 10_000 for r in got.select("doc_id").collect())
    assert ids[0] == known.where(F.col("text").rlike(r"\p{L}")).count() and ids[1] <= 20 and ids[2] == mixed.count()


def test_packing_spreads_rows_of_one_id(spark):
    """Nine rows out of ten without an id: shards stay small, batches whole, and nothing is lost."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.lit(7).cast("long").alias("length"))
    got = packing.pack(rows, max_length=512, budget=70, buckets=2, shard=1000)
    shards = [r["count"] for r in got.groupBy(F.substring_index("batch", "-", 2).alias("shard")).count().collect()]
    assert sum(shards) == 20_000 and len(shards) == 20 and max(shards) < 1500
    sizes = [r["count"] for r in got.groupBy("batch").count().collect()]
    assert max(sizes) == 10 and sum(s < 10 for s in sizes) <= len(shards)

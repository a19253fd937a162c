"""Encoding, token files, fingerprints, chat and personal data against the library or brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat, fingerprints, pii, tokenfiles
from tidemark.llm.ranges import ranges_of
from tidemark.llm.units import UnitEncoder, WordEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "Word", "WORD,", "été", "ÉTÉ.", "ſ", "İa", "ß!!", "'ll", "'s", "!", " ", "  ", "\n", "\t", "́", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "<|end", "23", "漢", "😀", "tion", "'", "$$$", "\r", "\x00"]
ROWS = [(1, "Hello  World"), (2, None), (3, ""), (4, "Hello  World"), (5, "x" * 50_000), (None, "lost id"), (5, "again"), (6, "<|endoftext|> a")]


def docs(spark, rows=ROWS):
    """Documents with columns whose names clash with results."""
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("ids", "length", "score", "kept", "n_words", "spans", "component_id", "fingerprint", "bucket", "id", "fp", "lang_pred"):
        made = made.withColumn(c, F.lit("clash"))
    return made


@pytest.mark.parametrize("path, long", [(BYTE, 32), (BYTE, 3), (WORD, 0)])
def test_units_encode_as_the_library(path, long):
    library, rng = Tokenizer.from_file(path), random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    texts += ["".join(rng.choice("abcdeth") for _ in range(rng.randint(200, 2000))) for _ in range(20)] + ["=" * 3000, " " * 999, "\n" * 99, None, ""]
    mine = UnitEncoder(path, 500, long, bpe._encode_long(long) if long else None)
    if not long:
        mine = WordEncoder(mine)
    for at in range(0, len(texts), 300):
        ids, sizes = mine.encode(texts[at : at + 300])
        stops = np.cumsum(sizes)
        for t, a, b in zip(texts[at : at + 300], stops - sizes, stops):
            assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
        assert mine.count(texts[at : at + 300]).tolist() == sizes.tolist()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(text):
    mine = _ANY.setdefault(0, UnitEncoder(BYTE, 5000, 8, bpe._encode_long(8)))
    ids, _ = mine.encode([text])
    assert ids.tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids
    assert bpe.ByteDecoder(mine.tokenizer).decode(ids) == text


_ANY: dict = {}


def test_round_trip_digests_are_the_librarys(spark):
    library, rows = Tokenizer.from_file(BYTE), ROWS + [(30 + k, "".join(random.Random(k).choice(PIECES) for _ in range(40))) for k in range(60)]
    got = bpe.roundtrip_digests(docs(spark, rows), BYTE).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for (_, t), r in zip(rows, got, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_decoder_is_the_library_on_random_ids():
    library, rng = Tokenizer.from_file(BYTE), np.random.default_rng(1)
    mine = bpe.ByteDecoder(library)
    for _ in range(300):
        ids = rng.integers(0, 50257, 15)
        assert mine.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_encode_and_decode_columns(spark):
    done = bpe.decode_ids(bpe.encode_texts(docs(spark), BYTE), BYTE).collect()
    assert [r["decoded"] for r in done] == [t or "" for _, t in ROWS]
    assert bpe.encode_texts(docs(spark, []), BYTE).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_number_coding(xs):
    x = np.array(xs, np.uint32)
    for kind in ("<u4", "<u2"):
        sizes = np.array([len(x) // 3, 0, len(x) - len(x) // 3])
        control, data, control_ends, data_ends = tokenfiles.encode_numbers(x.astype(kind), sizes)
        assert (tokenfiles.decode_numbers(control.tobytes(), data.tobytes(), sizes) == x.astype(kind)).all()
        assert control_ends[-1] == len(control) and data_ends[-1] == len(data)
        first = sizes[:1]  # a run can be cut out
        assert (tokenfiles.decode_numbers(control[: control_ends[0]].tobytes(), data[: data_ends[0]].tobytes(), first) == x.astype(kind)[: first[0]]).all()


def test_ranges_split_an_id_that_repeats(spark):
    rows = [(7, f"t{k}") for k in range(3000)] + [(None, f"n{k}") for k in range(1500)] + [(k, "x") for k in range(100, 600)]
    ranges = ranges_of(spark.createDataFrame(rows, "id long, text string"), "id", 10)
    got = ranges.bucket_of(pa.array([i for i, _ in rows], pa.int64()), [t for _, t in rows])
    assert Counter(got.tolist()).most_common(1)[0][1] < 800 and got.max() < ranges.count
    span = {i: (got[k].min(), got[k].max()) for i in (None, 7, 100, 599) if len(k := np.array([j for j, r in enumerate(rows) if r[0] == i]))}
    assert span[None][1] < span[7][0] and span[7][1] < span[100][0] <= span[599][1]
    one = ranges_of(spark.createDataFrame([], "id long"), "id", 10)
    assert one.bucket_of(pa.array([None, 3], pa.int64()), [None, "x"]).tolist() == [0, 1]


@pytest.mark.parametrize("block, files", [(1, 1), (7, 3), (65_536, 4)])
def test_token_files_read_back(spark, tmp_path, block, files):
    library = Tokenizer.from_file(WORD)
    tokenfiles.write_token_files(docs(spark), WORD, str(tmp_path / "t"), block_ids=block, files=files)
    got = sorted(((r["start"], r["doc_id"], r["ids"]) for r in tokenfiles.read_token_files(spark, str(tmp_path / "t")).collect()), key=lambda r: r[0])
    assert sorted((str(i), ids) for _, i, ids in got) == sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in ROWS)
    at = 0
    for start, _, ids in got:
        assert start == at
        at += len(ids)
    assert [i for _, i, _ in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    crc = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in tokenfiles.read_digests(spark, str(tmp_path / "t")).collect()}
    assert crc == {(i, s): zlib.crc32(np.array(ids, "<u4").tobytes()) for s, i, ids in got}


def test_empty_token_files(spark, tmp_path):
    tokenfiles.write_token_files(docs(spark, []), WORD, str(tmp_path / "t"))
    assert tokenfiles.read_digests(spark, str(tmp_path / "t")).count() == 0


def weak_digest(folded):
    return hashlib.md5(folded.encode()).hexdigest()[:1] + "0000000"


@pytest.mark.parametrize("digest", [fingerprints.wide_digest, weak_digest])
def test_fingerprints_mean_equal_folded_texts(spark, digest):
    rows = [(i, t) for i, t in enumerate(["Ab  c", "ab C ", "ﬁ", "FI", "x", None, "", " \n", *[f"text {k}" for k in range(40)]])]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(docs(spark, rows), digest_of=digest).collect()}
    for i, a in rows:
        assert got[i]["n_chars"] == len(a or "")
        for j, b in rows:
            assert (got[i]["fingerprint"] == got[j]["fingerprint"]) == (fingerprints.canonical(a) == fingerprints.canonical(b))


def test_repeated_and_null_ids_have_a_next_document(spark):
    rows = [(5, f"text {k}") for k in range(40)] + [(None, f"none {k}") for k in range(20)] + [(9, "same"), (9, "same")]
    got = fingerprints.with_next(docs(spark, rows).select("doc_id", "text"), n=4).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    following = Counter(r["next_folded"] for r in got)
    assert following == Counter(fingerprints.sha256(t) for _, t in rows)  # one circle over all rows


@pytest.mark.parametrize("digest", [fingerprints.wide_digest, weak_digest])
def test_edited_texts(spark, digest):
    rows = [(i * 3, "w%d " % (i % 5) * (i % 7)) for i in range(60)] + [(500, None), (501, "é" * 9)]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs(spark, rows), digest).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == float(fingerprints.canonical(t) == fingerprints.canonical(edited))
        assert r["near_next"] == float(fingerprints.canonical(t) == fingerprints.canonical(following))
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0


def test_chat_reads_back_exactly(spark):
    nasty = ["plain", "", None, "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "␛a␛z<s>", "ends with <|im_start", "\n\n"]
    turns = [(k, j, ["user", "assistant"][j % 2], nasty[(k + j) % len(nasty)]) for k in range(8) for j in range(4)] + [(9, 0, None, "x"), (9, None, "odd\nrole", "y"), (10, 0, "system", "s"), (10, 0, "system", "s"), (None, 1, "user", "z")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    done = chat.format_conversations(frame).select("conv_id", "valid", "segments", "formatted", chat.read_formatted(F.col("formatted")).alias("back"), chat.read_loss_text(F.col("segments")).alias("loss")).collect()
    got = {r["conv_id"]: r for r in done}
    for c in {t[0] for t in turns}:
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c))
        assert [(x["role"], x["text"]) for x in got[c]["back"]] == [(r, t) for _, _, r, t in mine]
        assert got[c]["loss"] == "".join(t for _, _, r, t in mine if r == "assistant")
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert got[0]["valid"] and not got[9]["valid"] and not got[10]["valid"]
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_chat_query_and_its_sql_agree(spark, tmp_path):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "␛a"), (2, None, "user", "null turn"), (2, 0, "assistant", None), (3, 1, None, ""), (3, 1, None, "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for folder in (str(tmp_path), "/root/testdata/sf0.01"):
        con = duckdb.connect()
        pattern = "/*.parquet" if folder == str(tmp_path) else ""
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet{pattern}')")
        got = chat.op3_chat(spark, folder)
        want = con.execute(chat.OP3_SQL).fetchdf()[got.columns]
        assert sorted(map(tuple, got.toPandas().to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))


def test_a_template_that_could_not_be_read_back_is_refused():
    with pytest.raises(ValueError):
        chat.Template(controls=("<|im_start|>", "<|im_end|>", "x<")).codes()


def brute_spans(t):
    out = []
    for kind, p in {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(8000):
        t = "".join(rng.choice(["1", "4", "12", ".", ".", "@", "a", "b.c", "-", "+", "(", ")", " ", "é", "%", "99", "0", "255", "4111111111111111", "5500 0000 0000 0004", "+1 (269) 555-3296"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == brute_spans(t), repr(t)
    assert pii.base_spans("1" * 200_000 + "@" * 200_000) == []  # linear time


def test_personal_data_is_found_and_redacted(spark):
    rows = [(i, f'token = "{hashlib.sha256(str(i).encode()).hexdigest()[:40]}" mail bob.{i}@mail.example.com') for i in range(60)]
    rows += [(100 + i, f"see version 2.{i}.0 and {4111111111111112 + 10 * i} of it") for i in range(60)] + [(300, "plain words only"), (301, None), (302, "")]
    frame = docs(spark, rows)
    found = pii.find(frame, pii.fit(frame))
    got = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert all([s["kind"] for s in got[i]] == ["secret", "email"] for i in range(60))
    assert got[300] == got[301] == got[302] == []
    assert sum(len(got[100 + i]) for i in range(60)) <= 12  # the few numbers that pass the card check
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame, pii.fit(frame)).collect()}
    assert clean[0] == 'token = "[SECRET]" mail [EMAIL]' and clean[300] == "plain words only" and clean[301] is None
    assert pii.find(frame.limit(0), pii.fit(frame.limit(0))).count() == 0


def test_further_personal_data_is_found(spark):
    """Names, addresses, grouped numbers, accounts and plain passwords beside secrets that teach the classifier."""
    rows = [(i, f'token = "{hashlib.sha256(str(i).encode()).hexdigest()[:40]}" and mail bob.{i}@mail.example.com, version 2.{i}.0, from 2019-{1 + i % 12}-28 on') for i in range(60)]
    asked = {
        "account": "IBAN DE89 3704 0044 0532 0130 00 here", "number": "call (555) 123-4567 now", "secret": "password: hunterx is it",
        "name": "ask Dr. Jane Smith about it", "place": "lives at 12 Oak Tree Lane since",
    }
    rows += [(100 + k, t) for k, t in enumerate(asked.values())] + [(200, "the years 2019-2020, on 2019-12-31, page 1234567 of it")]
    frame = docs(spark, rows)
    got = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.find(frame, pii.fit(frame)).collect()}
    wanted = ["DE89 3704 0044 0532 0130 00", "(555) 123-4567", "hunterx", "Dr. Jane Smith", "12 Oak Tree Lane"]
    assert [got[100 + k] for k in range(5)] == [[(kind, w)] for kind, w in zip(asked, wanted)]
    assert got[200] == []


def test_candidates_by_brute_force():
    """No two candidates overlap, none touches a base span, and every digit or at sign of a long enough token is in a span."""
    rng = random.Random(8)
    parts = ["a1b2c3d4", "bob@x.com", "x@", "12", "555 123 4567", "(030) 12-345", "password=", "token: abcd", "Mr. John Smith", "DE89 3704 0044 0532 0130 00", " ", " ", ",", "4111111111111111", "Hauptstraße 5", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        base = pii.base_spans(t)
        found = pii.candidates(t, base)
        spans = sorted((a, b) for _, a, b in found)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])), t
        assert not any(a < d and c < b for a, b in spans for _, c, d in base), t
        for m in re.finditer(r"[^ \t\n\r\x0b\x0c\"'<>(),;|=]+", t):
            token = m[0].strip(pii._EDGE)
            start = m.start() + m[0].index(token) if token else 0
            if len(token) >= 6 and re.search("[0-9@]", token):
                assert any(a < start + len(token) and start < b for a, b in [*spans, *((c, d) for _, c, d in base)]), (t, token)


@pytest.mark.parametrize("size", [16**4, 16**6])
def test_bitmap_of_prefixes_is_packed_in_tasks(spark, size):
    """Repeats count once, and slices without a number are there; the driver gets size / 8 bytes however many numbers there are."""
    numbers = spark.range(3_000_000).select(F.pmod(F.xxhash64(F.col("id") % 1_000_000), F.lit(size // 2)).cast("int").alias("p"))
    want = np.zeros(size, bool)
    want[numbers.select("p").distinct().toPandas()["p"].to_numpy()] = True
    got = fingerprints.bitmap(numbers, size)
    assert len(got) == size // 8 and got == np.packbits(want).tobytes()
    assert fingerprints.bitmap(numbers.limit(0), size) == bytes(size // 8)

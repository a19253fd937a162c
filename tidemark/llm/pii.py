"""Personal data (operator 9): weak-supervision aggregation over spans.

Base patterns give spans that always stay. Further candidates are tokens with digits or an at sign, groups of
digits, account numbers, values that a text assigns to a cue such as a password, names of people and street addresses. Labelers
of three sorts (patterns, gazetteers, context) vote on every span; expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is, and the posteriors train a span classifier on
hashed features, which decides on the candidates.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, map_arrow, table, unused
from tidemark.llm.weak import estimate

KINDS = ("email", "ip", "card", "phone", "secret", "address", "number", "account", "name", "place")
SAMPLE, BINS, THRESHOLD = 20_000, 4096, 0.5
#: How far labelers are believed to be better than chance: most of them have votes for one class alone.
TRUST = 0.3

# -- base spans ---------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, and giving back digits never helps it, so these take linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: from an at sign back over local characters, as far as the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Email, IP address, card and phone spans, in order of start, then kind."""
    if not _HIT.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# -- candidates and labelers ------------------------------------------------------------------------

_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>(),;|=")
_EDGE = ".,:!?*$%&#-"
_KEY = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{16,}|[0-9a-f]{32,64}")
# fixed values: words that speak for or against personal data, in the languages at hand
_ASSIGNED = "password passwd pwd passphrase secret token apikey api_key api-key passwort kennwort contraseña clave".split()
_CUES = frozenset([*_ASSIGNED, *"key access login user email mail phone tel fon mobile fax card visa iban account ssn passport ip host schlüssel konto karte telefon tarjeta cuenta teléfono correo courriel téléphone carte compte clé jeton call name born".split()])
_AGAINST = frozenset("version versión v release license licence lizenz licencia apache gnu gpl iso rfc page seite página chapter no nr figure copyright".split())
_ENDINGS = frozenset("com org net edu gov io de fr es info biz co uk eu".split())
_PREFIXES = ("+1", "+33", "+34", "+44", "+49", "34", "37", "4", "51", "52", "53", "54", "55", "6011", "AKIA", "ghp_", "sk-")
_TITLES = "Mr Mrs Ms Dr Prof Herr Herrn Frau Señor Señora Monsieur Madame Mme".split()
_GIVEN = "James John Robert Michael William David Richard Thomas Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Hans Peter Klaus Jürgen Wolfgang Anna Ursula Monika Petra Sabine Jean Pierre Michel François Marie Nathalie Isabelle Sophie José Juan Antonio Carlos Carmen Pilar Dolores Ana".split()
_WORD = re.compile(r"\w+")
_NAME = r"[A-ZÀ-Þ][a-zà-ÿ'-]{1,30}"
_GROUPS = re.compile(r"(?<![\w.+-])\(?[0-9]{2,}\)?(?:[ ./-]\(?[0-9]{2,}\)?)+(?!\w)")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[ /-](?:19|20)[0-9]{2}")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_VALUE = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(_ASSIGNED)})[\"']? {{0,3}}[=:] {{0,3}}[\"']?([^\s\"'<>(),;|]{{4,200}})")
_PERSON = re.compile(rf"(?<!\w)(?:(?:{'|'.join(_TITLES)})\.? {_NAME}|(?:{'|'.join(_GIVEN)}) {_NAME})(?: {_NAME})?")
_PLACES = (
    re.compile(rf"(?<!\w)[0-9]{{1,5}} (?:{_NAME} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)(?!\w)"),
    re.compile(r"(?<!\w)[A-ZÄÖÜ][a-zäöüß]{1,30}(?:straße|strasse|weg|platz|gasse) [0-9]{1,4}[a-z]?(?!\w)"),
    re.compile(rf"(?<!\w)[0-9]{{1,4}},? (?:rue|avenue|boulevard|place) (?:de |du |des |la |l')*{_NAME}"),
    re.compile(rf"(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza) (?:de |del |la )*{_NAME}(?: {_NAME})?,? [0-9]{{1,4}}(?!\w)"),
)
#: What any span needs; texts without it are not looked at further.
_SOME = rf"[0-9@]|(?i:{'|'.join(_ASSIGNED)})|\b(?:{'|'.join([*_TITLES, *_GIVEN])})\b"
NAMES = ("mail pattern", "number pattern", "key pattern", "account pattern", "person pattern", "place pattern", "gazetteer for", "gazetteer against", "cue before", "assigned", "mixture")


def with_spans(texts: pa.Array) -> list[tuple[int, str]]:
    """(row, text) of the texts that can have spans."""
    hit = pc.match_substring_regex(texts, _SOME).fill_null(False)
    rows = pc.indices_nonzero(hit)
    return list(zip(rows.to_pylist(), texts.take(rows).to_pylist()))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that touch no base span and not one another, with a provisional kind, by start: accounts, grouped digits, assigned values, addresses of
    streets, names, then tokens of six characters or more with a digit or an at sign. Of overlapping ones the first so listed stays."""
    taken = [(a, b) for _, a, b in base]
    found = [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
    found += [("number", *m.span()) for m in _GROUPS.finditer(text) if sum(c.isdigit() for c in m[0]) >= 7]
    found += [("secret", *m.span(1)) for m in _VALUE.finditer(text)]
    found += [("place", *m.span()) for p in _PLACES for m in p.finditer(text)]
    found += [("name", *m.span()) for m in _PERSON.finditer(text)]
    at = 0
    while m := _HIT.search(text, at):
        a = b = m.start()
        while a > at and text[a - 1] not in _STOP:
            a -= 1
        while b < len(text) and text[b] not in _STOP:
            b += 1
        at = max(b, m.end())
        found.append(("address" if "@" in text[a:b] else "secret" if any(c.isalpha() for c in text[a:b]) else "number", a, b))
    out, starts, ends = [], sorted(a for a, _ in taken), sorted(b for _, b in taken)
    for kind, a, b in found:
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while a < b and text[a] in _EDGE:
            a += 1
        if b - a >= (4 if kind in ("secret", "name") else 6) and bisect_left(starts, b) == bisect_right(ends, a):
            out.append((kind, a, b))
            insort(starts, a)
            insort(ends, b)
    return sorted(out, key=lambda s: s[1])


def account_checks(token: str) -> bool:
    """Whether the check digits of an international account number are right."""
    x = token.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def votes(text: str, span: tuple[str, int, int]) -> tuple[int, ...]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing. See NAMES."""
    kind, a, b = span
    token, before = text[a:b], text[max(0, a - 40) : a]
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    near = [w.lower() for w in _WORD.findall(before)[-3:]]
    worded = kind in ("name", "place")
    return (
        0 if "@" not in token else 1 if kind == "email" else -1,
        1 if kind in ("ip", "card", "phone") or kind == "number" and 9 <= digits <= 12 and _GROUPS.fullmatch(token) and not _DATE.fullmatch(token) else 0 if letters else -1,
        1 if _KEY.fullmatch(token) else -1 if len(token) < 12 and kind == "secret" and digits else 0,
        0 if kind != "account" else 1 if account_checks(token) else -1,
        1 if kind == "name" else 0,
        1 if kind == "place" else 0,
        1 if token.startswith(_PREFIXES) and digits >= 8 and kind != "number" or "@" in token and token.rsplit(".", 1)[-1] in _ENDINGS or kind == "name" and any(w in _GIVEN for w in token.split()) else 0,
        -1 if any(w in _AGAINST for w in near) or _DATE.fullmatch(token) else 0,
        1 if any(w in _CUES for w in near) or kind == "name" and token.split()[0].rstrip(".") in _TITLES else 0,
        1 if before.rstrip(" \"'").endswith(("=", ":")) else 0,
        1 if digits and letters and len(token) >= 16 else -1 if digits <= 4 and "@" not in token and not worded and kind != "secret" else 0,
    )


def features(text: str, span: tuple[str, int, int], voted: tuple[int, ...]) -> list[int]:
    """Hashed features of a span: its shape, length, make-up, ends, neighbouring words and what labelers say; never its kind."""
    _, a, b = span
    token, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    shape = re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"[0-9]+", "9", token[:64])))
    words = [w.lower() for w in _WORD.findall(before)[-2:]]
    tail = _WORD.match(after.strip())
    digits = sum(c.isdigit() for c in token)
    found = ["bias", f"shape {shape[:12]}", f"length {min(20, len(token)).bit_length()} {len(token)}", f"digits {min(digits, 20)}", f"part {digits * 4 // len(token)}", f"start {shape[:2]}", f"end {shape[-2:]}", f"sign {before.rstrip(' ')[-1:]}"]
    found += [f"before {w}" for w in words] + ([f"after {tail[0].lower()}"] if tail else []) + [f"has {c}" for c in sorted(set(token)) if not c.isalnum()]
    found += [f"vote {k} {v}" for k, v in enumerate(voted) if v]
    return [zlib.crc32(f.encode()) % BINS for f in found]


def train(rows: list[tuple[list[int], float, int]], epochs: int = 30, rate: float = 0.2, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights from hashed features, soft labels and how often a row occurs, by stochastic gradient steps in a fixed
    order; a row weighs 1 and the logarithm of its occurrences."""
    w, order = np.zeros(BINS), np.random.default_rng(11)
    rows = [(np.array(sorted(set(f))), y, 1 + math.log(n)) for f, y, n in rows]
    for epoch in range(epochs):
        step = rate / (1 + epoch / 4)
        for i in order.permutation(len(rows)):
            f, y, weight = rows[i]
            w[f] -= step * min(weight, 3.0) * (1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[f].sum()))))) - y + decay * w[f])
    return w


def fit(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights of the span classifier. All spans of all texts are voted on; the driver gets the counts of
    vote patterns (3 ** labelers at most) and, to train on, at most `sample` spans that differ in themselves or their
    surroundings, those with the smallest hashes, with the number of their occurrences: a line that repeats is one of them. Null and empty texts, and
    a table without spans, give weights of zero, which add no span."""
    docs = df.select(F.col(text).alias("text"))

    def spans(t: str):
        base = base_spans(t)
        return base + candidates(t, base)

    def count(batches):
        total = Counter()
        for batch in batches:
            for _, t in with_spans(batch.column("text")):
                total.update(votes(t, s) for s in spans(t))
        yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in total], pa.list_(pa.int32())), pa.array(list(total.values()), pa.int64())], names=["pattern", "n"])

    counts = map_arrow(docs, count, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {tuple(r["pattern"]): r["n"] for r in counts}
    _, _, posterior = estimate(counts, len(NAMES), balance=0.5, prior=TRUST)
    share = min(1.0, sample / max(1, sum(counts.values())))

    def draw(batches):
        rows: dict[int, list] = {}
        for batch in batches:
            for _, t in with_spans(batch.column("text")):
                for s in spans(t):
                    h = xxhash.xxh3_64_intdigest(f"{t[max(0, s[1] - 40) : s[1]]}\0{t[s[1] : s[2]]}\0{t[s[2] : s[2] + 20]}".encode()) >> 1
                    if h < share * 2**63:
                        if h in rows:
                            rows[h][3] += 1
                        else:
                            v = votes(t, s)
                            rows[h] = [h, features(t, s, v), list(v), 1]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows.values()], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()))], names=["h", "f", "v", "n"])

    drawn = map_arrow(docs, draw, "h long, f array<int>, v array<int>, n long").groupBy("h").agg(F.min(F.struct("f", "v")).alias("x"), F.sum("n").alias("n")).orderBy("h").limit(sample).collect()
    return train([(r["x"]["f"], posterior[tuple(r["x"]["v"])], r["n"]) for r in drawn])


def _finder(weights: np.ndarray, threshold: float):
    """All spans of a text as (kind, start, end, base), by start, then kind."""
    edge = math.log(threshold / (1 - threshold))

    def found(t: str) -> list[tuple[str, int, int, bool]]:
        base = base_spans(t)
        spans = [(*s, True) for s in base] + [(*s, False) for s in candidates(t, base) if weights[sorted(set(features(t, s, votes(t, s))))].sum() > edge]
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    return found


def find(df: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with spans array<struct<kind, start, end, base>> of the whole text, by start, then kind.

    Offsets are code points, ends exclusive. Base spans always stay; candidates are added where the
    classifier gives more than `threshold`. A null text has no spans. Rows are independent; a column of
    df with the name of the result is replaced.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def make():
        found = _finder(weights, threshold)

        def compute(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for i, t in with_spans(batch.column(text)):
                out[i] = [dict(zip(("kind", "start", "end", "base"), s)) for s in found(t)]
            return [pa.array(out, kind)]

        return compute

    return append_columns(df, {"spans": "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"}, make)


def redact(df: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with every span of its texts, as find() gives them, replaced by its kind in brackets (of overlapping
    spans the first), and n_chars, if there is one, renewed. A null text stays null."""

    def make():
        found = _finder(weights, threshold)

        def one(t: str) -> str:
            out, at = [], 0
            for kind, start, end, _ in found(t):
                if start >= at:
                    out += [t[at:start], f"[{kind.upper()}]"]
                at = max(at, end)
            return "".join(out) + t[at:]

        def compute(batch: pa.RecordBatch) -> list:
            texts = batch.column(text)
            changed = {i: new for i, t in with_spans(texts) if (new := one(t)) != t}
            rows = sorted(changed)
            mask = np.zeros(len(texts), bool)
            mask[rows] = True
            return [pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[i] for i in rows], pa.string())) if rows else texts]

        return compute

    new = unused(df, "redacted")
    done = append_columns(df, {new: "string"}, make)
    done = done.withColumn(text, F.col(new)).drop(new)
    return done.withColumn("n_chars", F.char_length(text).cast("long")) if "n_chars" in df.columns else done


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents: doc_id, counts per kind, base_sha256 and all spans; odd texts: see find()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs)).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )

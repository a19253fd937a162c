"""Language identification (operator 10): family first, then one-versus-one linear SVMs within the family.

Texts are hashed byte n-gram profiles. Languages whose profiles are alike form families (average-link
clustering of their mean profiles); a one-versus-rest linear support vector machine picks the family,
and pairwise ones vote within it. All are trained on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, map_arrow, table

BINS, ORDERS = 4096, (2, 3, 4)
#: Bounds of the training sample: documents in all (but one of each language at least), and documents of a language.
SAMPLE, PER_LANGUAGE = 6000, 1000
STEEPNESS, CHUNK = 4.0, 1 << 20
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]+")  # and numbers that are no digits, such as fractions
_TO_SPACE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def profile(text: str) -> np.ndarray:
    """Unit vector of the root counts of hashed byte 2- to 4-grams; letters are lower case, all else is a space."""
    data = text.lower().encode("utf-8", "replace").translate(_TO_SPACE)
    data = b" " + b" ".join(data.split()) + b" "
    total = np.zeros(BINS)
    for at in range(0, len(data), CHUNK):
        x = np.frombuffer(data[at : at + CHUNK + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        last = at + CHUNK >= len(data)
        code = x
        for k in range(1, max(ORDERS)):
            code = code[:-1] * np.uint32(257) + x[k:]
            if k + 1 in ORDERS and len(code):
                own = code if last else code[:CHUNK]
                total += np.bincount((own * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
    total = np.sqrt(total)
    return (total / max(1e-12, float(np.linalg.norm(total)))).astype(np.float32)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter of Unicode's category L."""
    return bool(text) and any(any(map(str.isalpha, m[0])) for m in _LETTER.finditer(text))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Linear SVM (L1 hinge loss) by dual coordinate descent; y is +1 or -1, classes weigh alike."""
    w, alpha, order = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), np.random.default_rng(seed)
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    norm = np.maximum(1e-12, (x * x).sum(1))
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            gradient = y[i] * float(x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def families_of(means: dict[str, np.ndarray], n: int | None = None) -> list[list[str]]:
    """Languages merged by how their mean profiles depart from the mean of all, most alike groups first
    (average link), down to about the root of their number."""
    middle = np.mean(list(means.values()), axis=0)
    means = {k: (v - middle) / max(1e-12, float(np.linalg.norm(v - middle))) for k, v in means.items()}
    groups = [[k] for k in sorted(means)]
    n = n or max(1, round(len(groups) ** 0.5))
    while len(groups) > n:
        alike = {(a, b): np.mean([means[x] @ means[y] for x in groups[a] for y in groups[b]]) for a, b in combinations(range(len(groups)), 2)}
        a, b = max(alike, key=lambda k: (alike[k], -k[0], -k[1]))
        groups[a] = sorted(groups[a] + groups[b])
        del groups[b]
    return groups


@dataclass
class LanguageModel:
    families: list[list[str]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pair_weights: dict = field(default_factory=dict)
    means: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str]) -> "LanguageModel":
        lang = np.array(lang, dtype=object)
        names = sorted(set(lang))
        if not names:
            return cls()
        means = np.stack([x[lang == k].mean(0) for k in names])
        families = families_of(dict(zip(names, means)))
        of = {k: f for f, group in enumerate(families) for k in group}
        which = np.array([of[k] for k in lang])
        family = np.stack([train_svm(x, np.where(which == f, 1, -1)) for f in range(len(families))]) if len(families) > 1 else None
        pairs = {}
        for group in families:
            for a, b in combinations(group, 2):
                rows = (lang == a) | (lang == b)
                pairs[a, b] = train_svm(x[rows], np.where(lang[rows] == a, 1, -1))
        return cls(families, family, pairs, means / np.maximum(1e-12, np.linalg.norm(means, axis=1, keepdims=True)))

    def likeness(self, x: np.ndarray) -> np.ndarray:
        """Cosine of each profile and the mean profile of the language that it is most like."""
        return (x @ self.means.T).max(1) if self.means is not None else np.zeros(len(x))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the weakest of the margins that decided, as a logistic value (0.5: undecided)."""
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        margin = np.full(len(x), np.inf)
        which = np.zeros(len(x), np.int64)
        if self.family_weights is not None:
            d = x @ self.family_weights.T
            which = d.argmax(1)
            top = np.sort(d, 1)
            margin = (top[:, -1] - top[:, -2]) / 2
        out = np.empty(len(x), dtype=object)
        for f, group in enumerate(self.families):
            rows = np.flatnonzero(which == f)
            votes, strength = np.zeros((len(rows), len(group))), np.zeros((len(rows), len(group)))
            sides = {}
            for (i, a), (j, b) in combinations(enumerate(group), 2):
                d = x[rows] @ self.pair_weights[a, b]
                sides[i, j] = d
                votes[:, i] += d > 0
                votes[:, j] += d <= 0
                strength[:, i] += d
                strength[:, j] -= d
            best = (votes + strength / (1e3 * (1 + np.abs(strength).max(initial=0)))).argmax(1)  # strength settles equal votes
            for (i, j), d in sides.items():
                margin[rows] = np.where(best == i, np.minimum(margin[rows], d), np.where(best == j, np.minimum(margin[rows], -d), margin[rows]))
            out[rows] = np.array(group, dtype=object)[best]
        return out.tolist(), 1 / (1 + np.exp(-STEEPNESS * np.clip(margin, -20, 20)))


def held_out(id: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from rows of df that are not held out and have a language and a letter.

    Of each language the documents with the smallest hashes of id and text are taken, about as many of each: at most
    per_language each and at most max(sample, number of languages) in all. Rows that repeat an id and its text
    are one document. A null id is an id like any other. Without such rows nothing is learned and every text is `und`.
    """
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return LanguageModel()
    each = max(1, min(per_language, sample // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * each / n))])
    rows = rows.withColumn("h", F.pmod(F.xxhash64("id", "text", F.lit("language sample")), F.lit(1 << 53)))
    taken = rows.filter(F.col("h") < F.try_element_at(share, F.col("lang")) * float(1 << 53))

    def profiles(batches):
        seen = set()
        for batch in batches:
            found = []
            for t, l, h in zip(*(c.to_pylist() for c in batch.columns)):
                if (l, h) not in seen and has_letter(t):
                    seen.add((l, h))
                    found.append((l, h, profile(t).astype(np.float16).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["lang", "h", "profile"])

    drawn = map_arrow(taken.select("text", "lang", "h"), profiles, "lang string, h long, profile binary").groupBy("lang", "h").agg(F.min("profile").alias("profile"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    got = sorted(drawn.withColumn("place", place).filter(F.col("place") <= each).collect(), key=lambda r: (r["lang"], r["profile"]))
    x = np.stack([np.frombuffer(r["profile"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, BINS), np.float32)
    return LanguageModel.fit(x, [r["lang"] for r in got])


def identify(df: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score", likeness: str | None = None) -> DataFrame:
    """df with columns `pred` and `score` (0 to 1) of the whole text, and `likeness` to the nearest learned language (0 to 1) where it is named. A text that is null or has no letter is `und`, score 0.

    Rows are independent; other columns pass through and are never looked at, except that columns with
    the names of the results are replaced.
    """

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            texts = batch.column(text).to_pylist()
            lang, sure, like = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            for at in range(0, len(texts), 512):
                rows = [i for i in range(at, min(at + 512, len(texts))) if has_letter(texts[i])]
                if rows:
                    x = np.stack([profile(texts[i]) for i in rows])
                    found, scores = model.predict(x)
                    like[rows] = model.likeness(x)
                    sure[rows] = scores
                    for i, l in zip(rows, found):
                        lang[i] = l
            return [pa.array(lang, pa.string()), pa.array(sure, pa.float64()), *([pa.array(like, pa.float64())] if likeness else [])]

        return compute

    return append_columns(df, {pred: "string", score: "double"} | ({likeness: "double"} if likeness else {}), make)


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model of those outside the held-out quarter: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.drop("lang"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))

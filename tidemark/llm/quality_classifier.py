"""Quality classifier (operator 1): a weak-label model and a hashed linear scorer.

Heuristic labelers vote for (1) or against (-1) each document or abstain (0). Expectation-maximisation over
the counts of vote patterns of the whole corpus estimates their accuracies; the posterior of a document's
pattern is its label, on which a logistic scorer of hashed byte n-grams and repetition measures is trained.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, map_arrow, table
from tidemark.llm.weak import estimate

BINS, ORDERS, CHUNK = 4096, (1, 2, 3), 1 << 20
#: The training sample, in documents, and the score from which a document is kept.
SAMPLE, THRESHOLD = 6000, 0.5
LABELERS = ("symbols", "capitals", "marks", "bars", "adjacent repeats", "repeated windows", "repeated lines", "common words", "sentences", "runs of marks", "plain words")
#: An objection is specific and rare, agreement is the rule: the log odds that a vote starts with.
IN_FAVOUR, AGAINST = 0.3, 4.0

_RUN = re.compile(rb"([^\w\s.\-\x80-\xff])\1")
_BARE = re.compile(rb"[A-Za-z\x80-\xff'-]+[.,;:?]?")


def measures(data: bytes) -> dict[str, float]:
    """Shares of a text that the labelers look at, and its number of words."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    counts = Counter(words)
    letters = int(n[65:91].sum() + n[97:123].sum())
    chars, w = max(1, int(n.sum())), max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    number = {x: i for i, x in enumerate(counts)}
    x = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    windows = (x[:-2] * len(number) + x[1:-1]) * len(number) + x[2:] if len(words) > 2 else x[:0]
    return {
        "runs": len(_RUN.findall(data)) / w,
        "plain": sum(n for v, n in counts.items() if _BARE.fullmatch(v)) / w,
        "words": len(words),
        "symbols": float(n[list(b"#*$%&<>{}~^")].sum()) / chars,
        "capitals": float(n[65:91].sum()) / max(1, letters),
        "marks": float(n[33]) / w,
        "bars": float(n[124]) / w,
        "adjacent": float((x[1:] == x[:-1]).sum()) / w,
        "windows": 1 - len(np.unique(windows)) / max(1, len(windows)) if len(windows) else 0.0,
        "lines": 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        "short": sum(n for v, n in counts.items() if len(v) <= 3 and v.isalpha()) / w,
        "ends": sum(n for v, n in counts.items() if v.endswith((b".", b"?", b"!", b".\""))) / w,
    }


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """One vote for each of LABELERS."""
    long = m["words"] >= 20

    def split(value: float, good: float, bad: float) -> int:
        return 1 if value <= good else -1 if value >= bad else 0

    return (
        split(m["symbols"], 0.005, 0.03),
        split(m["capitals"], 0.12, 0.35),
        split(m["marks"], 0.05, 0.4),
        split(m["bars"], 0.02, 0.3),
        split(m["adjacent"], 0.05, 0.2),
        split(m["windows"], 0.1, 0.4) if long else 0,
        split(m["lines"], 0.05, 0.3) if long else 0,
        split(-m["short"], -0.2, -0.05) if long else 0,
        1 if long and 0.02 <= m["ends"] <= 0.3 else -1 if long and (m["ends"] < 0.005 or m["ends"] > 0.6) else 0,
        split(m["runs"], 0.01, 0.1),
        split(-m["plain"], -0.9, -0.6),
    )


def hashed(data: bytes, m: dict[str, float]) -> np.ndarray:
    """Unit vector of the root counts of hashed byte n-grams, followed by repetition measures and a constant."""
    total = np.zeros(BINS)
    for at in range(0, max(1, len(data)), CHUNK):
        x = np.frombuffer(data[at : at + CHUNK + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        last, code = at + CHUNK >= len(data), x
        for k in range(max(ORDERS)):
            if k:
                code = code[:-1] * np.uint32(257) + x[k:]
            own = code if last else code[:CHUNK]
            total += np.bincount(((own + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
    total = np.sqrt(total)
    total /= max(1e-12, float(np.linalg.norm(total)))
    return np.concatenate([total, [m["adjacent"], m["windows"], m["lines"], 0.25]]).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights for soft labels y by accelerated gradient descent; both classes weigh alike."""
    if not len(x):
        return np.zeros(BINS + 4, np.float32)
    up, down = y / max(1e-9, y.sum()) / 2, (1 - y) / max(1e-9, (1 - y).sum()) / 2
    up, down = up.astype(np.float32), down.astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - np.float32(rate) * (((up + down) * p - up) @ x + np.float32(decay) * ahead)
        w, ahead = new, new + np.float32(k / (k + 3)) * (new - w)
    return w.astype(np.float32)


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights of the scorer. Every document is voted on; the driver gets the counts of vote patterns (at
    most 3 ** labelers) and the features of at most `sample` documents, those with the smallest hashes of id and
    text. Rows that repeat an id and its text count as often as they occur among the votes, but are one document of the sample.
    Null texts are empty ones, a null id is an id like any other; from an empty table come weights of zero."""
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def count(batches):
        total = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                total[votes(measures((t or "").encode()))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in total], pa.list_(pa.int32())), pa.array(list(total.values()), pa.int64())], names=["pattern", "n"])

    counts = {tuple(r["pattern"]): r["n"] for r in map_arrow(docs.select("text"), count, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    _, _, posterior = estimate(counts, len(LABELERS), in_favour=IN_FAVOUR, against=AGAINST, balance=0.5)
    share = min(1.0, sample / max(1, sum(counts.values())))
    h = F.pmod(F.xxhash64("id", "text", F.lit("quality sample")), F.lit(1 << 53))
    drawn = docs.withColumn("h", h).filter(F.col("h") < F.lit(min(1.0, 1.2 * share) * (1 << 53)))

    def describe(batches):
        seen = set()
        for batch in batches:
            rows = []
            for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist()):
                if h not in seen:
                    seen.add(h)
                    data = (t or "").encode()
                    m = measures(data)
                    rows.append((h, list(votes(m)), hashed(data, m).astype(np.float16).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int32()), pa.binary()))], names=["h", "pattern", "x"])

    found = map_arrow(drawn.select("text", "h"), describe, "h long, pattern array<int>, x binary").groupBy("h").agg(F.min(F.struct("pattern", "x")).alias("r"))
    got = sorted((r["r"] for r in found.orderBy("h").limit(sample).collect()), key=lambda r: (r["x"], r["pattern"]))
    if not got:
        return train(np.zeros((0, BINS + 4)), np.zeros(0))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    return train(x, np.array([posterior[tuple(r["pattern"])] for r in got], np.float32))


def classify(df: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1, of the whole text) and kept (score at least threshold).

    A null text counts as empty and is not kept. Rows are independent; other columns pass through, and
    columns with the names of the results are replaced.
    """

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            score = []
            for t in batch.column(text).to_pylist():
                data = (t or "").encode()
                z = float(hashed(data, measures(data)) @ weights) if data else -30.0
                score.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            return [pa.array(score, pa.float64()), pa.array([s >= threshold for s in score], pa.bool_())]

        return compute

    return append_columns(df, {"score": "double", "kept": "boolean"}, make)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Scores and verdicts of all documents by a scorer trained on posterior labels: doc_id, score, kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs)).select("doc_id", F.round("score", 6).alias("score"), "kept")

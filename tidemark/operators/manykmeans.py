"""Many k-means models over the same rows at once (F5): every k and start in one scan a round.

A task holds a batch of points against the centroids of all models that still move and hands on a sum per centroid; the driver
adds these up, a few hundred short vectors a task whatever the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import dealt

#: Points, those with the smallest hashes, from which starts are drawn; all points take part in the rounds.
SAMPLE = 2000


def scan(df: DataFrame, column: str, ks: range, starts: int, seed: int, rounds: int = 300) -> list[dict]:
    """For each k, the start with the least cost: k, cost (sum of squared distances), centers and silhouette (mean, by squared distances).

    Starts are drawn by k-means++ from at most SAMPLE points. A model rests when its centroids do; a centroid without a point stays. With
    fewer distinct points than k some clusters are empty. An empty table gives no models.
    """
    points = dealt(df.select(vector_to_array(column).alias("x")), "points")  # few bytes are much work here
    sample = points.orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()  # a bounded sample
    if not sample:
        return []
    drawn = np.array([r["x"] for r in sample])
    rng = np.random.default_rng(seed)
    models = [{"k": k, "centers": _plus_plus(drawn, k, rng), "cost": np.inf, "moves": True} for k in ks for _ in range(starts)]
    for _ in range(rounds):
        moving = [m for m in models if m["moves"]]
        if not moving:
            break
        for m, (n, total, squares, cost) in zip(moving, _pass(points, [m["centers"] for m in moving])):
            new = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], m["centers"])
            m |= {"moves": bool(np.abs(new - m["centers"]).max() > 1e-12 * (1 + np.abs(new).max())), "centers": new, "cost": cost, "sums": (n, total, squares)}
    best = [min((m for m in models if m["k"] == k), key=lambda m: m["cost"]) for k in ks]
    return [{"k": m["k"], "cost": m["cost"], "centers": m["centers"], "silhouette": s} for m, s in zip(best, _silhouettes(points, best))]


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [x[rng.integers(len(x))]]
    far = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(x[rng.choice(len(x), p=far / far.sum()) if far.sum() else rng.integers(len(x))])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest centroids and its squared distance; whole columns at once, since centroids are few and points many."""
    dots, length = centers @ x.T, (centers * centers).sum(1)
    own, best = np.zeros(len(x), "i8"), length[0] - 2 * dots[0]
    for k in range(1, len(centers)):
        far = length[k] - 2 * dots[k]
        own[far < best] = k
        np.minimum(best, far, out=best)
    return own, np.maximum(0, (x * x).sum(1) + best)


def _pass(points: DataFrame, all_centers: list[np.ndarray]) -> list[tuple]:
    """For each model: points, sums and sums of squared lengths per centroid, and the cost."""

    def run(batches):
        sums = [np.zeros((len(c), c.shape[1] + 3)) for c in all_centers]
        for batch in batches:
            x = _rows(batch)
            square = (x * x).sum(1)
            columns = [square, *np.ascontiguousarray(x.T)]
            for s, c in zip(sums, all_centers):
                own, far = _nearest(x, c)
                s[:, 0] += np.bincount(own, minlength=len(c))
                s[0, 2] += far.sum()  # only the sum of all centroids is asked for
                for j, v in zip((1, *range(3, s.shape[1])), columns):
                    s[:, j] += np.bincount(own, v, len(c))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sums).tobytes()], pa.binary())], names=["s"])

    got = points.mapInArrow(run, "s binary").collect()  # a row per task, a short vector per centroid in it: no shuffle in a round
    total, cuts = sum(np.frombuffer(r["s"]) for r in got).reshape(-1, all_centers[0].shape[1] + 3), np.cumsum([len(c) for c in all_centers])[:-1]
    return [(s[:, 0], s[:, 3:], s[:, 1], float(s[:, 2].sum())) for s in np.split(total, cuts)]


def _silhouettes(points: DataFrame, models: list[dict]) -> list[float]:
    """Mean silhouettes by squared distances, whose means over a cluster follow from its sums; a point alone in its cluster counts 0."""
    given = [(m["centers"], *_stats) for m, _stats in zip(models, [m[:3] for m in _pass(points, [m["centers"] for m in models])])]

    def run(batches):
        total = np.zeros((len(given), 2))
        for batch in batches:
            x = _rows(batch)
            row = np.arange(len(x))
            for t, (centers, n, sums, squares) in zip(total, given):
                own = _nearest(x, centers)[0]
                mean = np.where(n > 0, (x * x).sum(1)[:, None] + (squares - 2 * x @ sums.T) / np.maximum(1, n), np.inf)
                a = np.maximum(0, mean[row, own] * n[own] / np.maximum(1, n[own] - 1))
                mean[row, own] = np.inf
                b = mean.min(1)
                t += len(x), np.where((n[own] > 1) & np.isfinite(b), (b - a) / np.maximum(1e-300, np.maximum(a, b)), 0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(given)), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["model", "n", "s"])

    got = points.mapInArrow(run, "model int, n double, s double").groupBy("model").agg((F.sum("s") / F.sum("n")).alias("s")).collect()
    return [r["s"] for r in sorted(got, key=lambda r: r["model"])]

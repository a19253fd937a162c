"""Ranges of ids: split points that deal rows out evenly in id order, however often an id is repeated."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Ranges:
    """Numbered buckets in ascending order of ids, nulls first. An id that fills several ranges alone (and null, too)
    has as many buckets, among which its rows are dealt by a hash of their text."""

    def __init__(self, points: list[int], null_buckets: int = 1):
        parts: dict[int, int] = {}
        for point, same in groupby(sorted(points)):
            n = len(list(same))
            parts[point] = n
            if n > 1 and point < 2**63 - 1:
                parts[point + 1] = 1
        for point, same in groupby(sorted(points)):
            parts[point] = len(list(same))
        self.edges = np.array(sorted(parts), np.int64)
        self.parts = np.array([null_buckets, 1, *(parts[e] for e in sorted(parts))], np.int64)
        self.base = np.cumsum(self.parts) - self.parts
        self.count = int(self.parts.sum())

    def bucket_of(self, ids: pa.Array, texts: list[str | None]) -> np.ndarray:
        """The bucket of each row."""
        at = np.where(np.asarray(ids.is_null()), 0, 1 + np.searchsorted(self.edges, ids.fill_null(0).to_numpy(), side="right"))
        bucket = self.base[at]
        for i in np.flatnonzero(self.parts[at] > 1).tolist():
            bucket[i] += xxhash.xxh3_64_intdigest((texts[i] or "").encode()) % int(self.parts[at[i]])
        return bucket


def ranges_of(df: DataFrame, column: str, n: int) -> Ranges:
    """Ranges of a whole-number column with about as many rows each: n, and up to n more where ids are null. Only n split points and two counts come to the driver."""
    if n < 2:
        return Ranges([])
    points = F.percentile_approx(column, [i / n for i in range(1, n)], 10 * n)
    found = df.agg(points.alias("p"), F.count("*").alias("rows"), F.count(column).alias("known")).first()
    return Ranges(found["p"] or [], max(1, round(n * (found["rows"] - found["known"]) / max(1, found["rows"]))))

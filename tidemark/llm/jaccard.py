"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles, for the pipeline.

Texts with equal shingle sets are one class. Operator 5's index over Gray-ordered fingerprints proposes classes whose SimHash differs in at most its
4 bits. At the limit, similarity 0.8, fingerprints differ in 10 bits on average, and often in 15, beyond what
block masks can index, so MinHash bands propose the others: classes that agree on all ROWS minima of one of BANDS bands. Two texts of
similarity 0.8 share no band with probability (1 - 0.8^5)^28 = 1.5e-5, less if they are more alike. Components of these
suspects meet in a task with their shingle sets, where links are pairs of similarity LEAST or more, counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, map_arrow, materialize, partitions
from tidemark.llm.simhash import components, fingerprint, links

WORDS = 5
LEAST = (4, 5)  # similarity 0.8, as a fraction
BANDS, ROWS = 28, 5
SLICE = 2_048  # shingles whose permuted hashes are held at once

_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_FACTOR = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles in order, repeats included; a shorter text is one shingle, one without words none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words))))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes, sorted and distinct."""
    return np.unique(hashes(text, words))


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def bands(found: np.ndarray) -> list[int]:
    """A hash of each band's minima; the number of the band is its seed."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), SLICE):
        least = np.minimum(least, ((found[at : at + SLICE] ^ _XOR) * _FACTOR).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]


class Postings:
    """The members that hold a shingle, for the members given."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.members = members
        values = np.concatenate([sets[i] for i in members])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])[order]

    def shared(self, found: np.ndarray) -> np.ndarray:
        """How many of the shingles each member holds."""
        low, high = np.searchsorted(self.values, found, "left"), np.searchsorted(self.values, found, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.members))


def linked(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[int]:
    """For each set the first set reachable by links. Each set meets only those that are not yet reached, so a large group of copies
    takes few rounds; the postings are made anew when half of their members are reached."""
    sizes, first, open_ = np.array([len(s) for s in sets]), np.full(len(sets), -1), np.ones(len(sets), bool)
    index, left = Postings(sets, np.arange(len(sets))), len(sets)
    for start in range(len(sets)):
        if not open_[start]:
            continue
        first[start], open_[start], left, queue = start, False, left - 1, [start]
        while queue and left:
            if 2 * left < len(index.members):
                index = Postings(sets, np.flatnonzero(open_))
            x, m = queue.pop(), index.members
            both = index.shared(sets[x])
            found = m[open_[m] & (least[1] * both >= least[0] * (sizes[x] + sizes[m] - both))]
            first[found], open_[found], left = start, False, left - len(found)
            queue.extend(found.tolist())
    return first.tolist()


def _search(batches):
    """(set, component_id) of each class of a component of suspects; rows come sorted by (component, rep, set)."""

    def close(held):
        first = linked([np.frombuffer(s, np.uint64) for _, _, s in held])
        return pa.RecordBatch.from_arrays([pa.array([h[1] for h in held], pa.binary()), pa.array([held[k][0] for k in first], pa.int64())], names=["set", "component_id"])

    key, held = None, []
    for batch in batches:
        for component, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if component != key:
                if held:
                    yield close(held)
                key, held = component, []
            if not held or held[-1][:2] != row[:2]:  # a repeated row
                held.append(row)
    if held:
        yield close(held)


def alike(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all of classes(rep, fp) whose fingerprints are within operator 5's bits."""
    prints = materialize(classes.groupBy("fp").agg(F.min("rep").alias("least")), "prints")
    same = classes.join(prints, "fp").filter("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    return links(prints.select("fp", F.col("least").alias("rep"))).unionByName(same)


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of df: id, component_id, the smallest id reachable by links of similarity 0.8 or more.

    Texts cross the network once, to meet the list of suspects; of these only the shingle sets go on. Texts without words
    are alike. Rows with a null id are left alone (component null unless others share the set); repeated rows stay;
    other columns are ignored; an empty table gives an empty result.
    """

    def make():
        def signature(batch):
            sets, minima, prints = [], [], []
            for text in batch.column("text").to_pylist():
                every = hashes(text, words)
                found = np.unique(every)
                sets.append(digest(found))
                minima.append(bands(found))
                prints.append(fingerprint(every))
            flat = np.array(minima, np.uint64).view(np.int64).ravel()
            listed = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), pa.array(flat))
            return [pa.array(sets, pa.binary()), listed, pa.array(np.array(prints, np.uint64).view(np.int64))]

        return signature

    def sets(batches):
        for batch in batches:
            component, rep, of, t = batch.columns
            found = [shingles(x, words) for x in t.to_pylist()]
            out = pa.RecordBatch.from_arrays([component, rep, of, pa.array([s.tobytes() for s in found], pa.binary())], names=["component", "rep", "set", "shingles"])
            yield out.filter(pa.array([digest(s) == x for s, x in zip(found, of.to_pylist())], pa.bool_()))  # rows may share an id

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    prints = materialize(append_columns(rows, {"set": "binary", "bands": "array<bigint>", "fp": "bigint"}, make).select("id", "set", "bands", "fp"), "signatures")
    classes = materialize(prints.filter("id IS NOT NULL").groupBy("set").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    edges = keys.join(shared, "key").filter("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    suspects = classes.join(components(alike(classes).unionByName(edges)), F.col("rep") == F.col("node")).select("component", "rep", "set")
    met = rows.join(suspects, F.col("id") == F.col("rep")).select("component", "rep", "set", "text")
    placed = map_arrow(met, sets, "component long, rep long, set binary, shingles binary")
    placed = placed.repartition(partitions(df.sparkSession), "component").sortWithinPartitions("component", "rep", "set")
    labels = classes.join(map_arrow(placed, _search, "set binary, component_id long"), "set", "left").select("set", F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(labels, "set", "left").select(F.col("id").alias(id), "component_id")

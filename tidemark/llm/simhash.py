"""SimHash near-duplicates (operator 5) through a Gray-order hierarchical index.

Two fingerprints that differ in at most r bits agree on all bits of some choice of blocks (pigeonhole), so
every choice is an upper node: the shared masked bit pattern, with no difference so far. The rows under such a
pattern form a group in one task, sorted by Gray rank. There, nodes of FAN children keep the mask of bits that all
below share and their values; a pair of nodes whose shared bits already differ in more than r places is
pruned with all below it. Groups larger than a limit are cut, in Gray order, into blocks whose own masks
prune pairs of blocks before any row moves. Each group hands on a spanning forest of its links, never all
pairs, and minimum labels spread over these until they rest.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, map_arrow, materialize, partitions, table

WORDS, BITS, BLOCKS, GROUP = 4, 4, 6, 20_000
FAN = 16
SLICE = 20_000  # shingles whose hashes are counted at once


def simhash(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half the XXH64 (seed 42) of all word shingles."""
    found = (text or "").encode().lower().split()  # bytes.lower() folds A-Z, bytes.split() cuts at \x20 and \x09-\x0D
    if not found:
        return 0
    if len(found) < words:
        shingles, n = [b" ".join(found)], 1
    else:
        shingles, n = map(b" ".join, zip(*(found[i:] for i in range(words)))), len(found) - words + 1
    return fingerprint(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, n))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes of shingles, repeats included; zero without any."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, SLICE):
        ones += np.unpackbits(hashes[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_simhash(df: DataFrame, text: str = "text", name: str = "simhash", words: int = WORDS) -> DataFrame:
    """df with the fingerprint of the whole text as a (signed) long; a text without words has fingerprint zero."""

    def make():
        return lambda batch: [pa.array(np.array([simhash(t, words) for t in batch.column(text).to_pylist()], np.uint64).view(np.int64), pa.int64())]

    return append_columns(df, {name: "long"}, make)


def masks(bits: int, blocks: int) -> list[int]:
    """Bit masks of every choice of blocks - bits blocks; two fingerprints within `bits` bits agree under one of them at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    of = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(of[i] for i in chosen) for chosen in combinations(range(blocks), blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in Gray order: neighbours in that order differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _gray_rank(x: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayTree:
    """Nodes over fingerprints in Gray order: level 0 are the fingerprints, each higher node covers FAN nodes."""

    def __init__(self, fps: np.ndarray):
        self.values, self.shared = [fps], [np.full(len(fps), ~np.uint64(0))]
        while len(self.values[-1]) > 1:
            v, s = self.values[-1], self.shared[-1]
            at = np.arange(0, len(v), FAN)
            same = np.bitwise_and.reduceat(v & s, at) | np.bitwise_and.reduceat(~v & s, at)  # bits with one value all below
            self.values.append(v[at] & same)
            self.shared.append(same)


def find_links(a: GrayTree, b: GrayTree | None, bits: int, take) -> None:
    """Give take(i, j) arrays of linked leaves, of a itself (i < j) if b is None, from the top nodes down.

    A pair of nodes goes on only while the bits that all leaves of both share differ in few enough places.
    """
    other = b or a
    stack = [(len(a.values) - 1, len(other.values) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        known = a.shared[la][i] & other.shared[lb][j]
        near = np.bitwise_count((a.values[la][i] ^ other.values[lb][j]) & known) <= bits
        i, j = i[near], j[near]
        if la == lb == 0:
            if b is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                take(i, j)
            continue
        for at in range(0, len(i), 1024):
            x, y = i[at : at + 1024], j[at : at + 1024]
            down_a, down_b = (la >= lb and la > 0), (lb >= la and lb > 0)
            if down_a:
                kids = x[:, None] * FAN + np.arange(FAN)
                keep = (kids < len(a.values[la - 1])).ravel()
                x, y = kids.ravel()[keep], np.repeat(y, FAN)[keep]
            if down_b:
                kids = y[:, None] * FAN + np.arange(FAN)
                keep = (kids < len(other.values[lb - 1])).ravel()
                x, y = np.repeat(x, FAN)[keep], kids.ravel()[keep]
            if b is None and la == lb:
                x, y = x[x <= y], y[x <= y]
            stack.append((la - down_a, lb - down_b, x, y))


class Forest:
    """Links that join what was apart; labels are kept flat, so that links inside a tree drop out at once."""

    def __init__(self, n: int):
        self.label, self.members, self.kept = np.arange(n), {}, []

    def take(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.label[i] != self.label[j]
        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            a, b = int(self.label[x]), int(self.label[y])
            if a == b:
                continue
            ma, mb = self.members.pop(a, None) or [a], self.members.pop(b, None) or [b]
            if len(ma) < len(mb):
                a, b, ma, mb = b, a, mb, ma
            self.label[mb] = a
            ma.extend(mb)
            self.members[a] = ma
            self.kept.append((x, y))


def spanning_links(fps: np.ndarray, bits: int, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the links among fingerprints in Gray order, or only
    of those between the first `split` and the rest."""
    forest = Forest(len(fps))
    if split is None:
        find_links(GrayTree(fps), None, bits, forest.take)
    else:
        find_links(GrayTree(fps[:split]), GrayTree(fps[split:]), bits, lambda i, j: forest.take(i, j + split))
    return forest.kept


def _by_group(batches, columns: int):
    """Runs of equal leading columns over Arrow batches, as (key, the other columns as arrays); a run may span batches."""
    key, held = None, []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:columns]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new)])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cols[0])]):
            here = tuple(int(c[a]) for c in cols[:columns])
            if here != key:
                if held:
                    yield key, [np.concatenate(x) for x in zip(*held)]
                key, held = here, []
            held.append([c[a:b] for c in cols[columns:]])
    if held:
        yield key, [np.concatenate(x) for x in zip(*held)]


def _flush(rows: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)


def links(classes: DataFrame, bits: int = BITS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """Pairs (a, b) of rep that connect all of classes(fp, rep) that are linked: every link lies within a
    component of these pairs, and every pair is a link. fp are distinct signed 64-bit fingerprints."""
    spark = classes.sparkSession
    chosen = masks(bits, blocks)
    n = partitions(spark)
    keyed = classes.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in chosen])).alias("mask", "pattern"))
    keyed = keyed.select(F.col("mask").cast("long").alias("mask"), "pattern", gray_rank(F.col("fp")).alias("rank"), "fp", "rep")
    # ranks are unsigned; flipping the top bit sorts them so
    placed = keyed.repartition(n, "mask", "pattern").sortWithinPartitions("mask", "pattern", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))

    def search(batches):
        """Links (kind 0: a, b) of groups; rows of groups beyond the limit (kind 1: a = fp, b = rep) in numbered blocks."""
        out, names = [], ["kind", "mask", "pattern", "block", "a", "b"]
        for (mask, pattern), block, (_, fp, rep) in _runs(batches, group):
            if block:
                out += [(1, mask, pattern, block, f, r) for f, r in zip(fp.tolist(), rep.tolist())]
            elif len(fp) > 1:
                out += [(0, mask, pattern, 0, int(rep[i]), int(rep[j])) for i, j in spanning_links(fp.view(np.uint64), bits)]
            if len(out) >= 10_000:
                yield _flush(out, names)
                out = []
        if out:
            yield _flush(out, names)

    found = materialize(map_arrow(placed.select("mask", "pattern", "rank", "fp", "rep"), search, "kind long, mask long, pattern long, block long, a long, b long"), "links")
    small = found.filter("kind = 0").select("a", "b")
    large = found.filter("kind = 1")
    if large.isEmpty():
        return small.distinct()
    return small.unionByName(_large_links(large, bits, n)).distinct()


def _runs(batches, group: int):
    """(key, block, columns) for groups of equal (mask, pattern): block 0 is a whole group, blocks from 1 on are parts of a group beyond the limit."""

    def slices():
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                yield batch.slice(at, group)

    key, held, rows, block = None, [], 0, 0

    def close():
        if not held:
            return
        yield key, block + (block > 0), [np.concatenate(x) for x in zip(*held)]

    for batch in slices():
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        starts = np.concatenate([[0], 1 + np.flatnonzero(new)])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cols[0])]):
            here = (int(cols[0][a]), int(cols[1][a]))
            if here != key:
                yield from close()
                key, held, rows, block = here, [], 0, 0
            held.append([c[a:b] for c in cols[2:]])
            rows += b - a
            while rows > group:
                whole = [np.concatenate(x) for x in zip(*held)]
                block += 1
                yield key, block, [c[:group] for c in whole]
                held, rows = [[c[group:] for c in whole]], rows - group
    yield from close()


def _large_links(rows: DataFrame, bits: int, n: int) -> DataFrame:
    """Links inside groups that were cut into blocks: pairs of blocks whose shared bits allow a link meet in tasks of their own."""
    key = ["mask", "pattern"]
    nodes = rows.groupBy(*key, "block").agg(F.bit_and("a").alias("ones"), F.bit_and(F.bitwise_not("a")).alias("zeros"))
    left, right = (nodes.select(*key, *[F.col(c).alias(c + s) for c in ("block", "ones", "zeros")]) for s in ("_x", "_y"))
    shared = (F.col("ones_x").bitwiseOR(F.col("zeros_x"))).bitwiseAND(F.col("ones_y").bitwiseOR(F.col("zeros_y")))
    apart = F.bit_count(F.col("ones_x").bitwiseXOR(F.col("ones_y")).bitwiseAND(shared))
    pairs = left.join(right, key).filter((F.col("block_x") <= F.col("block_y")) & (apart <= bits)).select(*key, F.col("block_x").alias("x"), F.col("block_y").alias("y"))
    asked = pairs.select(*key, F.col("x").alias("block"), "x", "y").unionByName(pairs.filter("x < y").select(*key, F.col("y").alias("block"), "x", "y"))
    met = rows.join(asked, [*key, "block"]).select(*key, "x", "y", "block", gray_rank(F.col("a")).alias("rank"), F.col("a").alias("fp"), F.col("b").alias("rep"))
    met = met.repartition(n, *key, "x", "y").sortWithinPartitions(*key, "x", "y", "block", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))

    def search(batches):
        for (_, _, x, y), (block, _, fp, rep) in _by_group(batches, 4):
            split = None if x == y else int(np.searchsorted(block, y))
            pairs = spanning_links(fp.view(np.uint64), bits, split)
            yield _flush([(int(rep[i]), int(rep[j])) for i, j in pairs], ["a", "b"])

    return map_arrow(met, search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): the smallest node reachable.

    Large-star and small-star steps turn every component into a star around its smallest node, until a step
    changes nothing; their number grows with the square of the logarithm of the nodes at most. Each step is written to the shared folder, and only counts come to the driver.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    now, size = materialize(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbours of each node move to its smallest neighbour
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # smaller neighbours of each node, and the node, move to the smallest
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(down, "b")
        small = moved.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(moved.select(F.col("m").alias("x"), F.col("b").alias("y"))).filter("x < y").distinct()
        now = materialize(small.select(F.col("x").alias("a"), F.col("y").alias("b")), "edges")
        stars = now.agg(F.count("*"), F.count_distinct("b"), F.sum(F.hash("a", "b").cast("long"))).first()
        if stars == size and stars[0] == stars[1]:
            break
        size = stars
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """One row per row of df: id, simhash (signed long), component_id, the smallest id reachable by links of
    at most `bits` differing bits.

    Copies with equal fingerprints are one class from the start, so a class with a third of all rows
    costs a row per task. Null, empty and blank texts have fingerprint zero and are linked like any other.
    Rows with a null id are left alone (component null unless others share it); repeated rows stay; other
    columns are ignored; an empty table gives an empty result.
    """
    prints = materialize(with_simhash(df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), words=words).select("id", F.col("simhash").alias("fp")), "simhash")
    classes = prints.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"))
    of_class = materialize(classes, "classes")
    found = components(links(of_class, bits, blocks, group))
    labels = of_class.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(labels, "fp", "left").select(F.col("id").alias(id), F.col("fp").alias("simhash"), "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document at 4 differing bits: see near_duplicates() for null and empty texts and repeated rows."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")

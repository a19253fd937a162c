"""Eigenvector centrality by power iteration, for many networks at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import cut


#: Networks of at most this many edges and nodes are iterated within a task each, larger ones by joins.
SMALL_EDGES, SMALL_NODES = 1_000_000, 200_000


def power_iteration(edges: DataFrame, nodes: DataFrame, tol: float = 1e-8, max_iter: int = 100, shift: float = 0.0, small_edges: int = SMALL_EDGES, small_nodes: int = SMALL_NODES) -> DataFrame:
    """Dominant eigenvectors of the networks edges(key, src, dst, weight) over nodes(key, label).

    Starts from equal parts, multiplies by A + shift * I (a shift keeps bipartite networks from swinging),
    and stops when the vector moves by less than tol. A network of at most small_edges and small_nodes is iterated in the task of
    its key, larger ones together by joins, with the same steps. Returns key, label, centrality (unit length), eigenvalue
    (Rayleigh quotient of A), residual |Av - lv|, converged. Nodes without edges go to 0; a network
    without edges has zeros, eigenvalue 0. Edges to labels that are no nodes count for nothing. Not converging is reported, not an error.
    """
    links = cut(edges.select("key", "src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w")), "edges")
    start = cut(nodes.select("key", "label").distinct(), "nodes")
    many_nodes = start.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small_nodes).select("key")
    many_edges = links.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small_edges).select("key")
    large = cut(many_nodes.unionByName(many_edges).distinct(), "large")
    if large.isEmpty():
        return _in_tasks(links, start, tol, max_iter, shift)
    joined = _by_joins(links.join(large, "key", "left_semi"), start.join(large, "key", "left_semi"), tol, max_iter, shift)
    return joined.unionByName(_in_tasks(links.join(large, "key", "left_anti"), start.join(large, "key", "left_anti"), tol, max_iter, shift))


def _rows(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes (other is NULL) and links(key, src, dst, w) as rows of one table."""
    return nodes.withColumns({"other": F.lit(None).cast("string"), "w": F.lit(None).cast("double")}).unionByName(links.select("key", F.col("src").alias("label"), F.col("dst").alias("other"), "w"), allowMissingColumns=True)


def _ends(data: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A network's nodes, and the places of both ends and the weights of its links between nodes."""
    at_node = data["other"].isna()
    nodes, links = data[at_node], data[~at_node]
    index = pd.Index(nodes["label"])
    src, dst = index.get_indexer(links["label"]), index.get_indexer(links["other"])
    known = (src >= 0) & (dst >= 0)
    return nodes, src[known], dst[known], links["w"].to_numpy()[known]


def _in_tasks(links: DataFrame, start: DataFrame, tol: float, max_iter: int, shift: float) -> DataFrame:
    def iterate(key, data):
        nodes, src, dst, w = _ends(data)
        n = len(nodes)
        rows, columns, both = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])

        def times(x):
            return np.bincount(rows, both * x[columns], n)

        x, moved = np.full(n, 1 / np.sqrt(n)), np.inf
        for _ in range(max_iter):
            y = times(x) + shift * x
            y /= np.linalg.norm(y) or 1.0
            moved, x = np.linalg.norm(y - x), y
            if moved < tol:
                break
        y = times(x)
        value = float(x @ y / (x @ x or 1.0))
        return pd.DataFrame({"key": [key[0]] * n, "label": nodes["label"].to_numpy(), "centrality": x, "eigenvalue": value, "residual": float(np.linalg.norm(y - value * x)), "converged": bool(moved < tol)})

    links = links.join(start.select("key").distinct(), "key", "left_semi")
    kinds = ", ".join(f"{c} {start.schema[c].dataType.simpleString()}" for c in ("key", "label"))
    return _rows(start.where("key IS NOT NULL"), links).groupBy("key").applyInPandas(iterate, f"{kinds}, centrality double, eigenvalue double, residual double, converged boolean")


def _by_joins(links: DataFrame, start: DataFrame, tol: float, max_iter: int, shift: float) -> DataFrame:
    """A step is a join and a table. Networks that rest, tested after every step as in _in_tasks(), leave the iteration."""
    sym = cut(links.unionByName(links.select("key", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "links")
    size = start.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    active = cut(start.join(size, "key").select("key", "label", (1 / F.sqrt("n")).alias("x")), "vector")

    def times(x: DataFrame, plus: float) -> DataFrame:
        moved = sym.join(x.withColumnRenamed("label", "src"), ["key", "src"]).groupBy("key", F.col("dst").alias("label")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))
        return x.join(moved, ["key", "label"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)) + plus * F.col("x"))

    finished = []
    for step in range(1, max_iter + 1):
        raw = cut(times(active, shift), "product")
        norms = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        both = raw.join(norms, "key").select("key", "label", "x", F.coalesce(F.col("y") / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0)).alias("y"))
        moved = cut(both.groupBy("key").agg((F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))) < tol).alias("converged")), "moved")
        after = both.join(moved, "key").select("key", "label", F.col("y").alias("x"), "converged")
        rests, networks = moved.agg(F.count_if("converged"), F.count(F.lit(1))).first()
        if rests == networks or step == max_iter:
            finished.append(after)
            break
        if rests:
            finished.append(cut(after.where("converged"), "rested"))
        active = after.where(~F.col("converged")).drop("converged")
    v = cut(reduce(DataFrame.unionByName, finished), "vectors")
    plain = cut(times(v, 0.0), "product")
    value = plain.groupBy("key").agg(F.coalesce(F.sum(F.col("x") * F.col("y")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0)), F.lit(0.0)).alias("eigenvalue"))
    off = plain.join(value, "key").groupBy("key", "eigenvalue").agg(F.sqrt(F.sum(F.pow(F.col("y") - F.col("eigenvalue") * F.col("x"), 2))).alias("residual"))
    return v.join(off, "key").select("key", "label", F.col("x").alias("centrality"), "eigenvalue", "residual", "converged")


def centrality_by_year(edges: DataFrame, labels: DataFrame, years: DataFrame, frequency: DataFrame, **options) -> DataFrame:
    """A dense grid of labels and years: centrality, degree and frequency, zeros kept.

    edges (year, src, dst, weight), labels (label), years (year), frequency (label, year, n). The grid is
    the label universe times the years.
    """
    grid = years.select("year").crossJoin(labels.select("label"))
    found = power_iteration(edges.withColumnRenamed("year", "key"), grid.withColumnRenamed("year", "key"), **options).withColumnRenamed("key", "year")
    ends = edges.select("year", F.col("src").alias("label")).unionByName(edges.select("year", F.col("dst").alias("label")))
    degree = ends.groupBy("year", "label").agg(F.count(F.lit(1)).alias("degree"))
    out = grid.join(found, ["year", "label"], "left").join(degree, ["year", "label"], "left").join(frequency, ["year", "label"], "left")
    return out.select("label", "year", F.coalesce("centrality", F.lit(0.0)).alias("centrality"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("n", F.lit(0)).alias("frequency"), "converged", "residual")


def verify_centrality(edges: DataFrame, found: DataFrame, most: int = 2_000) -> DataFrame:
    """Per key of small networks the greatest difference and the cosine between a centrality and the dominant eigenvector
    of a dense solver, signs aligned, and whether they agree (below 1e-4, above 0.9999). A network of more than `most` nodes is not
    solved, its row has NULLs; there the residual of power_iteration() speaks."""
    size = found.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"))
    small = size.where(F.col("nodes") <= most).select("key")
    links = edges.join(small, "key", "left_semi").select("key", "src", "dst", F.col("weight").cast("double").alias("w"))
    rows = _rows(found.join(small, "key", "left_semi").select("key", "label", "centrality"), links)

    def solve(key, data):
        nodes, src, dst, w = _ends(data)
        a = np.zeros((len(nodes), len(nodes)))
        np.add.at(a, (src, dst), w)
        np.add.at(a, (dst, src), w)
        value, vectors = np.linalg.eigh(a)
        want, got = vectors[:, -1], nodes["centrality"].to_numpy()
        want = want * (np.sign(want @ got) or 1.0)
        difference = float(np.abs(want - got).max())
        cosine = float(want @ got / max(1e-300, np.linalg.norm(got)))
        return pd.DataFrame([(*key, difference, cosine, difference < 1e-4 and cosine > 0.9999)])

    kind = found.schema["key"].dataType.simpleString()
    solved = rows.groupBy("key").applyInPandas(solve, f"key {kind}, max_difference double, cosine double, agrees boolean")
    return size.join(solved, "key", "left")

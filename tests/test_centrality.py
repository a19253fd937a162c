import math

import numpy as np

from tidemark.operators import centrality as C


def test_triangle_and_isolated_node(spark):
    edges = spark.createDataFrame([(0, "a", "b", 1), (0, "b", "c", 1), (0, "a", "c", 1)], "key long, src string, dst string, weight long")
    nodes = spark.createDataFrame([(0, n) for n in "abcd"], "key long, label string")
    got = {r["label"]: r for r in C.power_iteration(edges, nodes).collect()}
    assert all(abs(got[n]["centrality"] - 1 / math.sqrt(3)) < 1e-8 for n in "abc") and abs(got["d"]["centrality"]) < 1e-8
    assert got["a"]["converged"] and abs(got["a"]["eigenvalue"] - 2) < 1e-8


def test_star_swings_without_a_shift(spark):
    edges = spark.createDataFrame([(0, "h", x, 1) for x in "abc"], "key long, src string, dst string, weight long")
    nodes = spark.createDataFrame([(0, n) for n in "habc"], "key long, label string")
    assert not C.power_iteration(edges, nodes, max_iter=20).first()["converged"]
    assert C.power_iteration(edges, nodes, max_iter=60, shift=1.0).first()["converged"]


def test_two_networks_at_once_match_dense_eigenvectors(spark):
    rng, edges, want = np.random.default_rng(4), [], {}
    for key in (1, 2):
        a = np.triu(rng.integers(0, 5, (8, 8)), 1)
        edges += [(key, f"n{i}", f"n{j}", int(a[i, j])) for i in range(8) for j in range(8) if a[i, j]]
        v = np.linalg.eigh(a + a.T)[1][:, -1]
        want |= {(key, f"n{i}"): abs(v[i]) for i in range(8)}
    nodes = spark.createDataFrame([(k, f"n{i}") for k in (1, 2) for i in range(8)], "key long, label string")
    got = C.power_iteration(spark.createDataFrame(edges, "key long, src string, dst string, weight long"), nodes, max_iter=200).collect()
    assert max(abs(r["centrality"] - want[r["key"], r["label"]]) for r in got) < 1e-4
    assert all(r["residual"] < 1e-4 for r in got)


def test_tasks_and_joins_give_the_same_vectors(spark):
    rng = np.random.default_rng(9)
    edges = [(key, f"n{i}", f"n{j}", int(rng.integers(1, 9))) for key in (1, 2, 3) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.2 * key]
    edges += [(1, "n0", "stranger", 5), (1, "n1", "n2", None), (4, "n0", "n1", 1)]
    nodes = [(key, f"n{i}") for key in (1, 2, 3, 5) for i in range(14)]
    tables = spark.createDataFrame(edges, "key long, src string, dst string, weight long"), spark.createDataFrame(nodes + nodes[:3], "key long, label string")
    most = sorted(sum(e[0] == key for e in edges) for key in (1, 2, 3))[1]
    want = {(r["key"], r["label"]): r for r in C.power_iteration(*tables, max_iter=30, shift=1.0).collect()}
    got = C.power_iteration(*tables, max_iter=30, shift=1.0, small_edges=most).collect()  # the network with the most edges by joins
    assert sorted(want) == sorted((r["key"], r["label"]) for r in got) == sorted(nodes)
    for r in got:
        assert all(abs(r[c] - want[r["key"], r["label"]][c]) < 1e-12 for c in ("centrality", "eigenvalue", "residual"))
        assert r["converged"] == want[r["key"], r["label"]]["converged"]


def test_networks_leave_the_joins_at_their_own_steps(spark):
    """A triangle rests at once, a path of three late, a star never without a shift: the same vectors and verdicts as in tasks, at any limit of steps."""
    edges = [("t", "a", "b", 1), ("t", "b", "c", 1), ("t", "a", "c", 1), ("p", "a", "b", 3), ("p", "b", "c", 1), ("p", "a", "c", 1), ("s", "a", "b", 1), ("s", "a", "c", 1)]
    tables = spark.createDataFrame(edges, "key string, src string, dst string, weight long"), spark.createDataFrame([(k, n) for k in "tpse" for n in "abc"], "key string, label string")
    for steps in (1, 12):
        want = {(r["key"], r["label"]): r for r in C.power_iteration(*tables, max_iter=steps, tol=1e-3).collect()}
        got = {(r["key"], r["label"]): r for r in C.power_iteration(*tables, max_iter=steps, tol=1e-3, small_edges=0, small_nodes=0).collect()}
        assert sorted(got) == sorted(want) and len(got) == 12
        for at, r in got.items():
            assert all(abs(r[c] - want[at][c]) < 1e-12 for c in ("centrality", "eigenvalue", "residual")) and r["converged"] == want[at]["converged"]
        assert {k for (k, _), r in got.items() if r["converged"]} == ({"t"} if steps == 1 else {"t", "p", "e"})

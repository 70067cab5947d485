"""Level loops handle each entry once, and hubs send no pairs."""

import numpy as np
import pytest
from conftest import dense, matrix, values, vector

from matloom.model import Graph
from matloom.operators import factor, graph, structure, triangular


def test_early_hub_sends_updates_in_the_pattern_only(spark, ws):
    n = 40
    star = np.eye(n) * 50
    star[0, 1:] = star[1:, 0] = -1
    star[1, 2] = star[2, 1] = -1
    a = matrix(spark, star.tolist())
    plan = factor.Elimination(ws, a.df.where("i <= j").select("i", "j"), n, "chol")
    # One update per edge for the diagonal, and the star's only triangle.
    assert plan.updates.rows == n + 1
    u = np.linalg.cholesky(star).T
    got = dense(factor.incomplete_cholesky(ws, a, 0).matrix)
    product = got.T @ got
    assert np.allclose(product[star != 0], star[star != 0])
    assert np.allclose(got[0], u[0])


def test_triangles(spark):
    edges = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (3, 4)]
    found = graph_rows(factor.triangles(spark.createDataFrame(edges, "a long, b long")))
    assert found == [(0, 1, 2), (1, 2, 3)]


def graph_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_unsymmetric_ilu0(spark, ws):
    m = np.array([[4, 1, 0, 2], [1, 5, 1, 0], [0, 2, 6, 1], [0, 0, 1, 7.0]])
    f = dense(factor.incomplete_lu(ws, matrix(spark, m.tolist()), 0).matrix)
    want = m.copy()
    for i in range(1, 4):
        for k in range(i):
            if m[i, k]:
                want[i, k] /= want[k, k]
                for j in range(k + 1, 4):
                    if m[i, j]:
                        want[i, j] -= want[i, k] * want[k, j]
    assert np.allclose(f, want)


def test_solve_of_a_chain_sends_each_product_once(spark, ws):
    n = 7
    low = np.eye(n) * 2 + np.diag([1.0] * (n - 1), -1)
    b = list(range(1, n + 1))
    t = triangular.TriangularSolve(ws, matrix(spark, low.tolist()), "lower", vector(spark, [2] * n))
    assert t.depth == n
    assert np.allclose(values(t.solve(vector(spark, b))), np.linalg.solve(low, b))
    assert spark.read.parquet(f"{ws.root}/sent-*").count() == n - 1
    with pytest.raises(ValueError):
        triangular.TriangularSolve(ws, matrix(spark, low.tolist()), "lower", by="guess")


def test_search_on_directed_and_symmetric_arcs(spark, ws):
    arcs = [(0, 1), (1, 2), (2, 0), (2, 3)]
    vertices = spark.range(4)
    one_way = Graph(spark.createDataFrame(arcs, "src long, dst long"), vertices)
    assert graph_rows(graph.bfs_levels(ws, one_way, 0)) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    both = Graph(spark.createDataFrame(arcs + [(b, a) for a, b in arcs], "src long, dst long"), vertices)
    assert graph.is_symmetric(graph.pin_edges(ws, both.edges).df)
    assert graph_rows(graph.bfs_levels(ws, both, 0)) == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_compressed_rows_round_trip(spark, ws):
    m = [[0, 1, 2], [0, 0, 0], [0, 0, 0], [3, 0, 4], [0, 0, 0]]
    ptr, body = structure.to_csr(ws, matrix(spark, m), base=1)
    assert [r["ptr"] for r in ptr.orderBy("i").collect()] == [1, 3, 3, 3, 5, 5]
    assert dense(structure.from_csr(ws, ptr, body, 5, 3, base=1)).tolist() == m


def test_large_sums_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """A task of a sum over the lines holds a bounded share of them."""
    from matloom import runtime
    from matloom.operators import sums
    from matloom.sources import tables

    monkeypatch.setattr(runtime, "TASK_ROWS", 10)
    lines = [(k % 7 if k % 11 else None, k % 50, float(k % 5)) for k in range(400)]
    df = spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(7).toDF("s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(50).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    a = tables.supply_matrix(spark, str(tmp_path))
    assert a.df.rdd.getNumPartitions() == 40
    want = {}
    for i, j, v in lines:
        want[i, j] = want.get((i, j), 0.0) + v
    assert {(r["i"], r["j"]): r["v"] for r in a.df.collect()} == want
    gone = sums.add(a, a, -1.0).df.collect()
    assert {(r["i"], r["j"]): r["v"] for r in gone} == dict.fromkeys(want, 0.0)

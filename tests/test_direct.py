"""Nested dissection, panels and multigrid against numpy."""

import numpy as np
import pytest
from conftest import dense, matrix, values, vector

from matloom import SparseMatrix
from matloom.model import Graph
from matloom.operators import disjoint, dissection, multigrid, ordering, panels, triangular
from matloom.operators.factor import PivotError
from matloom.plans import krylov, solvers


def grid(side, shift=0.0):
    """The five-point matrix of a square grid."""
    n = side * side
    m = np.zeros((n, n))
    for k in range(n):
        m[k, k] = 4.0 + shift
        if k % side:
            m[k, k - 1] = m[k - 1, k] = -1.0
        if k >= side:
            m[k, k - side] = m[k - side, k] = -1.0
    return m


def fill(m, order):
    """Cells of the complete factor and the height of its tree."""
    p = (m[np.ix_(order, order)] != 0).copy()
    n, height = len(m), np.zeros(len(m), int)
    for k in range(n):
        after = np.flatnonzero(p[k, k + 1 :]) + k + 1
        p[np.ix_(after, after)] = True
        if len(after):
            height[after[0]] = max(height[after[0]], height[k] + 1)
    return int(np.triu(p).sum()), int(height.max()) + 1


def order_of(p):
    return [r["old_id"] for r in p.df.orderBy("new_id").collect()]


def test_dissection_fills_less(spark, ws):
    m = grid(9)
    rng = np.random.default_rng(1)
    mixed = rng.permutation(len(m))
    m = m[np.ix_(mixed, mixed)]
    g = Graph.of(matrix(spark, m.tolist()))
    d = dissection.dissect(ws, g, leaf=6)
    p = d.permutation(ws, ordering.vertex_degrees(g))
    assert dissection.separated(d, p, g.edges.where("src <> dst")).where("NOT separated").isEmpty()
    order = order_of(p)
    assert sorted(order) == list(range(len(m)))
    rcm = order_of(ordering.reverse_cuthill_mckee(ws, g))
    (nd, tree), (band, chain), (given, _) = fill(m, order), fill(m, rcm), fill(m, range(len(m)))
    print(f"cells: dissection {nd}, rcm {band}, given {given}; tree height {tree} and {chain}")
    assert nd < band and nd < given and tree < chain / 2


def test_dissection_of_stars_cliques_and_nothing(spark, ws):
    star = np.eye(30)
    star[0, :] = star[:, 0] = 1
    for m in (star, np.ones((9, 9)), np.eye(5)):
        g = Graph.of(matrix(spark, m.tolist()))
        d = dissection.dissect(ws, g, leaf=4)
        assert d.tree.count() == len(m)
        p = d.permutation(ws, ordering.vertex_degrees(g))
        assert dissection.separated(d, p, g.edges.where("src <> dst")).where("NOT separated").isEmpty()
    hub = dissection.dissect(ws, Graph.of(matrix(spark, star.tolist())), leaf=4)
    assert {r["id"] for r in hub.tree.where("depth = 0").collect()} == {0}


@pytest.mark.parametrize("kind", ["positive", "indefinite", "general"])
def test_panels_solve(spark, ws, kind):
    m = grid(5, {"positive": 0.1, "indefinite": -1.3, "general": 0.0}[kind])
    if kind == "general":
        m = np.where(np.tril(m, -1) != 0, 0.5 * m, m)
    b = np.arange(len(m)) % 5 + 1.0
    f = panels.PanelFactor(ws, matrix(spark, m.tolist()), kind, leaf=8)
    x = values(f(vector(spark, b)))
    assert np.allclose(m @ x, b, atol=1e-9)
    assert 2 <= f.depths <= 8
    if kind == "indefinite":
        assert f.inertia == (int((np.linalg.eigvalsh(m) < 0).sum()), int((np.linalg.eigvalsh(m) >= 0).sum()))


def test_zero_diagonal_needs_pivots_inside_a_block(spark, ws):
    m = np.array([[0.0, 2, 0, 0], [2, 0, 1, 0], [0, 1, 0, 3], [0, 0, 3, 0]])
    a = matrix(spark, m.tolist())
    b = vector(spark, [1, 2, 3, 4])
    for kind in ("indefinite", "general"):
        s = solvers.DirectSolver(ws, a, kind, max_iter_ref=2)
        assert np.allclose(m @ values(s.solve(b)), [1, 2, 3, 4])
    assert solvers.DirectSolver(ws, a, "indefinite").inertia == (2, 2)


def test_failures_are_told(spark, ws):
    singular = matrix(spark, [[1, 1], [1, 1]])
    with pytest.raises(PivotError):
        solvers.DirectSolver(ws, singular, "positive")
    with pytest.raises(PivotError):
        solvers.DirectSolver(ws, singular, "general").solve(vector(spark, [1, 2]))
    # A load the matrix can carry is solved, although a pivot was replaced.
    x = values(solvers.DirectSolver(ws, singular, "indefinite").solve(vector(spark, [2, 2])))
    assert np.allclose(sum(x), 2)


def test_large_blocks_go_to_the_elimination_by_cells(spark, ws):
    m = grid(3, 1.0)
    b = np.ones(9)
    for a in (matrix(spark, m.tolist(), positive_definite=True), matrix(spark, m.tolist())):
        s = solvers.DirectSolver(ws, a, max_front=3)
        assert s._panels is None
        assert np.allclose(m @ values(s.solve(vector(spark, b))), b)


def test_multigrid_needs_fewer_steps(spark, ws):
    m = grid(10, 0.02)
    a = matrix(spark, m.tolist(), positive_definite=True)
    b = vector(spark, np.ones(len(m)))
    cycle = multigrid.Multigrid(ws, a, coarse=12)
    assert len(cycle.sizes) >= 2 and cycle.sizes[1] < len(m) / 4
    amg = krylov.pcg(ws, a, b, cycle, rel_tol=1e-8)
    ic0 = solvers.create("cg+ic0", ws, a)(b)
    print("steps", amg.iterations, ic0.iterations, "sizes", cycle.sizes)
    assert amg.converged and amg.iterations < ic0.iterations
    assert np.allclose(m @ values(amg.x), 1, atol=1e-6)


def test_roots_are_far_apart_and_leave_no_gap(spark, ws):
    m = grid(7)
    a = matrix(spark, m.tolist())
    arcs = ws.save(multigrid.strong_arcs(a, 0.08)).df
    roots = {r["id"] for r in multigrid.distant_roots(ws, arcs).collect()}
    near = (m != 0) @ (m != 0)
    assert all(not near[x, y] for x in roots for y in roots if x != y)
    assert all(near[x, list(roots)].any() for x in range(len(m)))
    member, count = multigrid.aggregates(ws, arcs)
    assert member.count() == len(m) == member.select("id").distinct().count() and count == len(roots)


def test_cycle_is_symmetric_and_coarse_solver_may_be_direct(spark, ws):
    m = grid(7, 0.3)
    a = matrix(spark, m.tolist())
    cycle = multigrid.Multigrid(ws, a, coarse=0, max_levels=1)
    x, y = np.arange(49) % 3 + 1.0, np.arange(49) % 4 - 1.0
    mx, my = values(cycle(vector(spark, x))), values(cycle(vector(spark, y)))
    assert np.isclose(np.dot(mx, y), np.dot(my, x))
    assert dense(cycle.last).shape[0] == cycle.sizes[-1]
    assert isinstance(cycle.last, SparseMatrix)


def test_long_chains_take_few_rounds(spark, ws):
    n = 1000
    cells = spark.range(1, n).selectExpr("id AS i", "id - 1 AS j", "0.5D AS v")
    solve = triangular.ContractedSolve(ws, SparseMatrix(cells, n, n), "lower")
    assert len(solve.powers) <= 11
    want, last = [], 0.0
    for k in range(n):
        last = k % 7 + 1 - 0.5 * last
        want.append(last)
    assert np.allclose(values(solve.solve(vector(spark, [k % 7 + 1 for k in range(n)]))), want)


@pytest.mark.parametrize("growth", [0.0, 1.0, 100.0])
def test_contracted_solve_stops_squaring_when_it_fills(spark, ws, growth):
    rng = np.random.default_rng(3)
    m = np.where(rng.random((20, 20)) < 0.3, rng.normal(size=(20, 20)), 0)
    upper = np.triu(m, 1) + np.diag(np.arange(20) + 1.0)
    d = vector(spark, np.diag(upper))
    x = triangular.ContractedSolve(ws, matrix(spark, upper.tolist()), "upper", d, growth).solve(vector(spark, np.ones(20)))
    assert np.allclose(upper @ values(x), 1)


def test_sets_grow_by_batches(spark, ws):
    rng = np.random.default_rng(6)
    path = ws.new_path("sets")
    links, root = [], list(range(40))
    for k in range(3):
        part = [tuple(map(int, x)) for x in rng.integers(0, 40, (7, 2))]
        links += part
        df = spark.createDataFrame(part, "a long, b long")
        sets = disjoint.DisjointSets(ws, path, fold=2)
        assert sets.unite(df, f"b{k}") and not sets.unite(df, f"b{k}")
        for a, b in part:
            low, high = sorted((root[a], root[b]))
            root = [high if r == low else r for r in root]
        got = {r["id"]: r["root"] for r in sets.find(spark.range(40)).collect()}
        assert got == dict(enumerate(root))
    met = {x for link in links for x in link}
    assert {r["id"]: r["root"] for r in disjoint.DisjointSets(ws, path).all().collect()} == {x: root[x] for x in met}

import numpy as np
import pytest
from conftest import dense, matrix, values, vector

from matloom import DenseMatrix
from matloom.operators import factor, fill, triangular
from matloom.plans import eigen, krylov, solvers


def spd(n, seed, density=0.25):
    rng = np.random.default_rng(seed)
    low = np.tril(np.where(rng.random((n, n)) < density, -rng.random((n, n)), 0.0), -1)
    sym = low + low.T
    return sym + np.diag(np.abs(sym).sum(1) + 1.0)


@pytest.fixture(scope="module")
def system(spark):
    raw = spd(10, 3, 0.3)
    b = np.arange(1.0, 11.0)
    return raw, matrix(spark, raw.tolist(), positive_definite=True), b, vector(spark, b)


def test_triangular_solves(ws, spark, system):
    raw, a, b, bv = system
    n = len(b)
    low = np.tril(raw, -1) + np.eye(n)
    assert np.allclose(values(triangular.forward_substitution(ws, a, bv)), np.linalg.solve(low, b))
    assert np.allclose(values(triangular.TriangularSolve(ws, a, "lower").sweep(bv)), np.linalg.solve(low, b))
    d = vector(spark, np.diag(raw))
    got = triangular.backward_substitution(ws, a, d, bv)
    assert np.allclose(values(got), np.linalg.solve(np.triu(raw), b))


def leveled_rows(raw, k, upper_only):
    """Row by row fill levels, as a check of the round based rule."""
    n = len(raw)
    lev = np.where(raw != 0, 0, 99)
    for q in range(n):
        for i in range(q + 1, n):
            for j in range(q + 1, n):
                cand = lev[i, q] + lev[q, j] + 1
                if cand <= k and cand < lev[i, j]:
                    lev[i, j] = cand
    return {(i, j, int(lev[i, j])) for i in range(n) for j in range(n) if lev[i, j] <= k and (i <= j or not upper_only)}


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_fill_levels(ws, system, k):
    raw, a, _, _ = system
    got = {tuple(r) for r in fill.ic_pattern(ws, a.df, k).select("i", "j", "level").collect()}
    assert got == leveled_rows(raw, k, True)
    got = {tuple(r) for r in fill.ilu_pattern(ws, a.df, k).select("i", "j", "level").collect()}
    assert got == leveled_rows(raw, k, False)


def test_complete_factors(ws, system):
    raw, a, b, bv = system
    u = dense(factor.complete_cholesky(ws, a).matrix)
    assert np.allclose(u, np.linalg.cholesky(raw).T)
    f = factor.complete_lu(ws, a)
    lu = dense(f.matrix)
    assert np.allclose((np.tril(lu, -1) + np.eye(len(b))) @ np.triu(lu), raw)
    assert np.allclose(values(factor.FactorSolve(ws, f)(bv)), np.linalg.solve(raw, b))


def ilut_rows(raw, tau, fill_in):
    """Row-wise ILUT for comparison."""
    n = len(raw)
    rows, out = [], np.zeros_like(raw)
    for i in range(n):
        w = raw[i].copy()
        norm = np.linalg.norm(raw[i])
        for k in range(i):
            if w[k] != 0:
                w[k] /= rows[k][k]
                if abs(w[k]) < tau * norm:
                    w[k] = 0.0
                    continue
                w[k + 1:] -= w[k] * rows[k][k + 1:]
        u = np.where(np.abs(w) >= tau * norm, w, 0.0)
        keep = sorted((j for j in range(i + 1, n) if u[j]), key=lambda j: (-abs(u[j]), j))[:fill_in]
        lows = sorted((j for j in range(i) if w[j]), key=lambda j: (-abs(w[j]), j))[:fill_in]
        row = np.zeros(n)
        row[i] = w[i]
        row[keep] = w[keep]
        rows.append(row)
        out[i] = row
        out[i, lows] = w[lows]
    return out


def test_threshold_lu_matches_the_row_version(ws, system):
    raw, a, _, _ = system
    got = dense(factor.incomplete_lu_threshold(ws, a, 0.02, 3).matrix)
    assert np.allclose(got, ilut_rows(raw, 0.02, 3))


def memory_rows(raw, lsize, rsize):
    """Left-looking fill-memory Cholesky for comparison."""
    n = len(raw)
    keep, extra = np.zeros_like(raw), np.zeros_like(raw)
    for i in range(n):
        w = np.where(np.arange(n) >= i, raw[i], 0.0)
        for k in range(i):
            both = keep[k] + extra[k]
            w[i:] -= keep[k, i] * both[i:] + extra[k, i] * keep[k, i:]
        root = np.sqrt(w[i])
        quota = int((raw[i, i + 1:] != 0).sum()) + min(lsize, n - i - 1)
        order = sorted((j for j in range(i + 1, n) if w[j]), key=lambda j: (-abs(w[j]), j))
        keep[i, i] = root
        keep[i, order[:quota]] = w[order[:quota]] / root
        rest = order[quota:quota + rsize]
        extra[i, rest] = w[rest] / root
    return keep


def test_fill_memory_cholesky_matches_the_row_version(ws, system):
    raw, a, _, _ = system
    got = dense(factor.cholesky_with_memory(ws, a, lsize=1, rsize=2).matrix)
    assert np.allclose(got, memory_rows(raw, 1, 2))


def test_indefinite_matrix_needs_a_shift(ws, spark):
    a = matrix(spark, [[1.0, 2.0], [2.0, 1.0]])
    f = factor.incomplete_cholesky(ws, a, 0)
    assert f.shift >= 1.0 and np.isfinite(dense(f.matrix)).all()


def test_solvers_agree(ws, system):
    raw, a, b, bv = system
    want = np.linalg.solve(raw, b)
    for got in (
        krylov.pcg(ws, a, bv, "jacobi"),
        krylov.fgmres(ws, a, bv, restart=6, left=factor.FactorSolve(ws, factor.incomplete_lu(ws, a, 0))),
        solvers.create("cg+ic0", ws, a)(bv),
    ):
        assert got.converged and np.allclose(values(got.x), want, atol=1e-5)
    assert not krylov.pcg(ws, a, bv, max_iters=1).converged


def test_registry_refuses_doubles_and_unknown_names(ws, system):
    assert not solvers.register("cg", lambda *a: None)
    assert solvers.create("no such solver", ws, system[1]) is None


def test_exhausted_basis_gives_no_spurious_value(ws, spark):
    """A start vector with few eigencomponents ends the basis early."""
    raw = np.diag([2.0, 2.0, 2.0, 5.0, 5.0, 9.0])
    pair = eigen.lanczos(ws, matrix(spark, raw.tolist()), vector(spark, [1, 2, 3, 4, 5, 6]), which="S", ncv=6)[0]
    assert pair.iterations == 3 and np.isclose(pair.value, 2.0)


def test_eigenvalues(ws, system):
    raw, a, _, bv = system
    theta = np.linalg.eigvalsh(raw)
    top = eigen.lanczos(ws, a, bv, nev=2, ncv=10)
    assert np.allclose([p.value for p in top], theta[::-1][:2])
    assert eigen.eigen_residual(a, top[0]).first()["residual"] < 1e-6
    low = eigen.lanczos(ws, a, bv, which="S", ncv=10)[0]
    assert np.isclose(low.value, theta[0])


def test_orthonormal_columns(ws, spark):
    raw = np.array([[1, 1, 1], [0, 1, 1], [0, 0, 1.0]])
    cells = [(i, j, float(raw[i, j])) for i in range(3) for j in range(3)]
    q = dense(eigen.orthonormalize(ws, DenseMatrix(spark.createDataFrame(cells, "i long, j long, v double"), 3, 3)))
    assert np.allclose(np.abs(q), np.eye(3), atol=1e-14)

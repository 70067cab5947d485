"""Restarted, generalised and resumed eigenvalue iterations against numpy."""

import numpy as np
import pytest
from conftest import matrix, values, vector

from matloom.plans.krylov import NotConverged
from matloom.plans.krylov_schur import KrylovSchur, general_residual

N = 16


def problem():
    rng = np.random.default_rng(5)
    a = np.diag(np.append(np.linspace(1, 6, N - 2), [9.0, 12.0])) + 0.3 * (np.eye(N, k=1) + np.eye(N, k=-1))
    b = np.diag(1 + rng.random(N)) + 0.2 * (np.eye(N, k=1) + np.eye(N, k=-1))
    return a, b, np.ones(N) + rng.random(N)


def eigenvalues(a, b):
    half = np.linalg.inv(np.linalg.cholesky(b))
    return np.linalg.eigvalsh(half @ a @ half.T)


def test_restarts_keep_the_basis_narrow(spark, ws):
    a, _, x = problem()
    solver = KrylovSchur(ws, matrix(spark, a.tolist()), nev=2, ncv=6, tol=1e-5)
    pairs = solver.run(vector(spark, x))
    assert np.allclose([p.value for p in pairs], np.linalg.eigvalsh(a)[::-1][:2], atol=1e-4)
    assert solver.widest <= 6 < pairs[0].iterations


def test_sparse_mass_matrix(spark, ws):
    a, b, x = problem()
    ma, mb = matrix(spark, a.tolist()), matrix(spark, b.tolist())
    pair = KrylovSchur(ws, ma, mb, nev=1, ncv=8, tol=1e-3).run(vector(spark, x))[0]
    assert np.isclose(pair.value, eigenvalues(a, b)[-1], atol=1e-3)
    v = np.array(values(pair.vector))
    assert np.isclose(v @ b @ v, 1.0) and general_residual(ma, pair, mb) < 1e-2
    near = KrylovSchur(ws, ma, mb, nev=1, ncv=6, tol=1e-3, shift=3.0).run(vector(spark, x))[0]
    every = eigenvalues(a, b)
    assert np.isclose(near.value, every[np.argmin(abs(every - 3.0))], atol=1e-2)


def test_resumed_run_equals_the_uninterrupted(spark, ws):
    a, _, x = problem()
    m, state = matrix(spark, a.tolist()), ws.new_path("state")
    make = lambda state: KrylovSchur(ws, m, nev=1, ncv=4, tol=1e-4, state=state)
    with pytest.raises(NotConverged):
        make(state).run(vector(spark, x), max_restarts=1)
    # The start is not needed any more.
    late = make(state).run(vector(spark, np.zeros(N)))
    whole = make(None).run(vector(spark, x))
    assert [p.iterations for p in late] == [p.iterations for p in whole]
    assert np.allclose([p.value for p in late], [p.value for p in whole], rtol=1e-12)

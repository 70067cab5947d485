"""Bases of eigenvalue iterations: one write per step, in buckets or not."""

import numpy as np
import pytest
from conftest import matrix, vector

from matloom import runtime
from matloom.plans import eigen, krylov_schur

N = 16


@pytest.mark.parametrize("bucket_rows", [None, 5])
def test_one_write_per_step(spark, ws, monkeypatch, bucket_rows):
    if bucket_rows:
        for module in (runtime, eigen, krylov_schur):
            monkeypatch.setattr(module, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(5)
    a = np.diag(np.append(np.linspace(1, 6, N - 2), [9.0, 12.0])) + 0.3 * (np.eye(N, k=1) + np.eye(N, k=-1))
    top = np.linalg.eigvalsh(a)[-1]
    m, x = matrix(spark, a.tolist()), vector(spark, np.ones(N) + rng.random(N))
    written, save = [], ws.save

    def counted(df, *args, **kwargs):
        written.extend(["V"] * ("w" in df.columns))
        return save(df, *args, **kwargs)

    monkeypatch.setattr(ws, "save", counted)
    whole = krylov_schur.KrylovSchur(ws, m, nev=1, ncv=4, tol=1e-4).run(x)[0]
    assert np.isclose(whole.value, top, atol=1e-4)
    assert len(written) == whole.iterations
    state = ws.new_path("state")
    make = lambda: krylov_schur.KrylovSchur(ws, m, nev=1, ncv=4, tol=1e-4, state=state)
    make().run(x, max_restarts=1, partial=True)
    late = make().run(x)[0]
    assert late.iterations == whole.iterations and np.isclose(late.value, whole.value, rtol=1e-12)
    written.clear()
    pair = eigen.lanczos(ws, m, x, ncv=8)[0]
    assert np.isclose(pair.value, top, atol=1e-4)
    assert pair.iterations <= len(written) <= pair.iterations + 1

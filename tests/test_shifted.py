"""Shifted systems of all ports at once."""

import numpy as np
import pytest
from conftest import matrix

from matloom import runtime
from matloom.plans import pipelines


def _case(n=24):
    rng = np.random.default_rng(5)
    half = np.triu(rng.integers(-2, 3, (n, n)) * (rng.random((n, n)) < 0.1), 1).astype(float)
    k = half + half.T
    k += np.diag(abs(k).sum(1) + 10.0 ** rng.integers(0, 7, n))
    m = np.diag(rng.integers(1, 8, n).astype(float))
    g = (rng.integers(0, 3, n)[:, None] == np.arange(3)).astype(float)
    return k, m, g


@pytest.mark.parametrize("bucket_rows", [None, 4])
def test_systems_of_uneven_scale_take_few_steps(spark, ws, monkeypatch, bucket_rows):
    if bucket_rows:
        monkeypatch.setattr(runtime, "BUCKET_ROWS", bucket_rows)
        monkeypatch.setattr(pipelines, "BUCKET_ROWS", bucket_rows)
    k, m, g = _case()
    freqs = [1.0, 2.5]
    made = [matrix(spark, x.tolist()) for x in (k, m, g)]
    found = pipelines.shifted_solves(ws, *made, freqs, max_iters=24).collect()
    got = np.zeros((6, len(k)))
    for row in found:
        assert row["f"] == freqs[row["sys"] % 2]
        got[row["sys"], row["i"]] = row["v"]
    assert len({(row["sys"], row["i"]) for row in found}) == len(found)
    for port in range(3):
        for at, f in enumerate(freqs):
            assert np.allclose(got[port * 2 + at], np.linalg.solve(f * m + k, g[:, port]), atol=1e-9)
    # Replaced rounds leave no tables behind.
    assert len(ws.tables) == (0 if bucket_rows is None else 2)

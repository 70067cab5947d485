"""Cases that once gave wrong or incomplete answers."""

import numpy as np
import pytest
from conftest import dense, matrix, vector

from matloom import DenseMatrix, Workspace
from matloom.plans import eigen, krylov, pipelines
from matloom.runtime import Pinned
from matloom.sources.generators import random_pattern
from matloom.sources.matrix_market import read_matrix_market


def test_folder_of_parts(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "part-0").write_text("1 2 5.0\n2 2\t4.0\n")
    (folder / "part-1").write_text("%%MatrixMarket matrix coordinate real general\n% note\n\t2 2 3 \n1 1 2.0\n")
    m = read_matrix_market(spark, str(folder))
    assert dense(m).tolist() == [[2.0, 5.0], [0.0, 4.0]]


def test_dependent_columns_get_a_complete_basis(spark, ws):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 4))
    a[:, 1] = 2 * a[:, 0]
    a[:, 3] = a[:, 0] - a[:, 2]
    cells = [(i, j, float(a[i, j])) for i in range(40) for j in range(4)]
    q = dense(eigen.orthonormalize(ws, DenseMatrix(spark.createDataFrame(cells, "i long, j long, v double"), 40, 4)))
    assert np.allclose(q.T @ q, np.eye(4), atol=1e-12)
    assert np.allclose(q @ (q.T @ a), a, atol=1e-10)


def test_lanczos_goes_on_until_the_pairs_converge(spark, ws):
    rng = np.random.default_rng(4)
    raw = rng.normal(size=(12, 12))
    raw = raw + raw.T
    start = vector(spark, rng.normal(size=12).tolist())
    pairs = eigen.lanczos(ws, matrix(spark, raw.tolist()), start, nev=2, ncv=3, tol=1e-9)
    assert all(p.converged for p in pairs)
    assert np.allclose([p.value for p in pairs], np.sort(np.linalg.eigvalsh(raw))[::-1][:2])
    with pytest.raises(eigen.NotConverged):
        eigen.lanczos(ws, matrix(spark, raw.tolist()), start, nev=2, ncv=3, tol=1e-12, max_iters=3)
    assert len(eigen.lanczos(ws, matrix(spark, raw.tolist()), start, nev=2, ncv=3, tol=1e-12, max_iters=3, partial=True)) == 2


def test_random_pattern_keeps_its_rows(spark):
    m = random_pattern(spark.range(3).withColumnRenamed("id", "i"), 10, 2, seed=1, nrows=3)
    assert (m.nrows, m.ncols) == (3, 10)


def test_indefinite_matrix_is_refused(spark, ws):
    a = matrix(spark, [[1.0, 0.0], [0.0, -3.0]])
    with pytest.raises(krylov.NotPositiveDefinite):
        krylov.pcg(ws, a, vector(spark, [1.0, 1.0]))


def test_unconverged_answers_are_errors(spark, ws):
    a = matrix(spark, [[4, 1, 0], [1, 3, 1], [0, 1, 2]], positive_definite=True)
    short = krylov.pcg(ws, a, vector(spark, [1, 2, 3]), max_iters=1)
    with pytest.raises(krylov.NotConverged):
        short.checked()
    port = matrix(spark, [[1], [2], [3]])
    eye = matrix(spark, np.eye(3).tolist())
    with pytest.raises(krylov.NotConverged, match="1 of 2"):
        # Shifted by -10 the first system is negative definite and never moves.
        pipelines.shifted_solves(ws, a, eye, port, [-10.0, 1.0], max_iters=8)


def test_closed_workspace_leaves_no_table_or_folder(spark, tmp_path):
    with Workspace(spark) as ws:
        cells = spark.range(100).selectExpr("id AS i", "id % 3 AS j", "1.0D AS v")
        pinned = Pinned(ws, cells, "j", bucket_rows=10)
        assert pinned.table in [t.name for t in spark.catalog.listTables()]
        assert pinned.df.count() == 100
        ws.save(cells).df.write.parquet(str(tmp_path / "kept"))
        folder, fs = ws._located(ws.root)
        assert fs.exists(folder)
    assert not fs.exists(folder)
    assert pinned.table not in [t.name for t in spark.catalog.listTables()]
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 100


def test_bucket_count_stays_within_the_limit(spark, ws):
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "4")
    try:
        pinned = Pinned(ws, spark.range(100).selectExpr("id % 7 AS j", "id AS i"), "j", bucket_rows=2)
        assert pinned.df.count() == pinned.join(spark.range(7).withColumnRenamed("id", "j")).count() == 100
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")

"""What loops send through the driver and sweep again."""

import numpy as np
from conftest import matrix, vector
from pyspark.sql import functions as F

from matloom.operators.triangular import TriangularSolve

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def test_tables_of_a_loop_are_not_sent_through_the_driver(spark, ws):
    """A join of two vectors of some megabytes, as each round of a solver has one."""
    make = lambda seed, name: ws.save(spark.range(400_000).select(F.col("id").alias("i"), F.rand(seed).alias(name))).df
    x, y = make(1, "x"), make(2, "y")
    before = spark.conf.get(THRESHOLD)
    assert "BroadcastHashJoin" in x.join(y, "i")._jdf.queryExecution().executedPlan().toString()
    seen, read = [], spark.conf.get

    joined = x.join(y, "i").withColumn("t", F.lit(1))
    writer = type(joined.write).parquet

    def watched(self, path, *args, **kwargs):
        seen.append(read(THRESHOLD))
        return writer(self, path, *args, **kwargs)

    type(joined.write).parquet = watched
    try:
        saved = ws.save(joined, rows=F.count(F.lit(1)))
    finally:
        type(joined.write).parquet = writer
    assert saved.rows == 400_000
    assert seen == [str(1024 * 1024)]
    assert spark.conf.get(THRESHOLD) == before


def test_smaller_thresholds_of_a_session_stay(spark, ws):
    from matloom.runtime import modest_broadcasts

    before = spark.conf.get(THRESHOLD)
    try:
        for given, inside in (("-1", "-1"), ("256k", "256k"), ("10MB", "1048576"), ("10485760b", "1048576"), ("64m", "1048576")):
            spark.conf.set(THRESHOLD, given)
            with modest_broadcasts(spark):
                assert spark.conf.get(THRESHOLD) == inside
            assert spark.conf.get(THRESHOLD) == given
    finally:
        spark.conf.set(THRESHOLD, before)


def test_sweeps_go_over_rows_behind_the_first_level_only(spark, ws):
    rng = np.random.default_rng(3)
    m = np.tril(rng.integers(-3, 4, (40, 40)) * (rng.random((40, 40)) < 0.06), -1).astype(float)
    m[10, 9] = m[11, 10] = m[12, 11] = 2.0
    d = rng.integers(1, 5, 40).astype(float)
    b = rng.integers(-9, 9, 40).astype(float)
    for diag in (None, d):
        solve = TriangularSolve(ws, matrix(spark, m.tolist()), "lower", None if diag is None else vector(spark, diag), by="sweeps")
        got = {r["i"]: r["v"] for r in solve.apply(vector(spark, b)).df.collect()}
        want = np.linalg.solve(m + np.diag(np.ones(40) if diag is None else diag), b)
        assert sorted(got) == list(range(40))
        assert np.allclose([got[i] for i in range(40)], want)
        behind = {i for i in range(40) if m[i].any()}
        assert solve._inner.rows == sum(m[i, j] != 0 for i in range(40) for j in behind) < np.count_nonzero(m)
    none = TriangularSolve(ws, matrix(spark, np.eye(3).tolist()), "lower", None, by="sweeps")
    assert [r["v"] for r in none.apply(vector(spark, [1, 2, 3])).df.orderBy("i").collect()] == [1.0, 2.0, 3.0]


def test_small_tables_of_a_loop_stay_in_the_tasks(spark, ws):
    """A loop has hundreds of joins, so tables of some 100 kB are too large for each."""
    from matloom.runtime import modest_broadcasts

    make = lambda seed, name: ws.save(spark.range(20_000).select(F.col("id").alias("i"), F.rand(seed).alias(name))).df
    x, y = make(1, "x"), make(2, "y")
    keys = ("spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    with modest_broadcasts(spark):
        plan = x.join(y, "i")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert [spark.conf.get(k, None) for k in keys] == before
    assert ws.save(x.join(y, "i"), rows=F.count(F.lit(1))).rows == 20_000

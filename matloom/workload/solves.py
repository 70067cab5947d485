"""Linear solver, eigenvalue and pipeline queries.

A solver is right when its answer, multiplied by the matrix again, gives back
the load; an eigenpair when its residual is small and its value is known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matloom.model import SparseMatrix, Vector
from matloom.operators import products
from matloom.plans import eigen, krylov, krylov_schur, pipelines, solvers
from matloom.runtime import Workspace
from matloom.sources import generators, tables as src
from matloom.workload.registry import query
from matloom.workload.sqltext import CELLS, LOAD, STIFF, with_

_B = with_(LOAD) + "SELECT i, v FROM b"


def _applied_back(a, x: Vector):
    return products.matvec(a, x).df.select("i", (F.round("v", 4) + 0.0).alias("v"))


def _named(name: str, **knobs):
    def run(spark, sf):
        ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
        got = solvers.create(name, ws, k, **knobs)(b)
        return _applied_back(k, got.checked() if isinstance(got, krylov.Solution) else got)

    return run


query("cg_solve", _B)(_named("cg", rel_tol=1e-8))
query("pcg_ic0", _B)(_named("cg+ic0", rel_tol=1e-8))
query("pcg_ick", _B)(_named("cg+incomplete_cholesky_k", level=1, rel_tol=1e-8))
query("pcg_ic_memory", _B)(_named("cg+incomplete_cholesky_fm", lsize=2, rsize=2, rel_tol=1e-8))
query("pcg_amg", _B)(_named("cg+amg", rel_tol=1e-8))
query("gmres", _B)(_named("gmres", rel_tol=1e-8))
query("gmres_ilu0", _B)(_named("gmres+ilu0", rel_tol=1e-8))
query("gmres_iluk", _B)(_named("gmres+iluk", level=1, rel_tol=1e-8))
query("gmres_ilut", _B)(_named("gmres+ilut", rel_tol=1e-8))
query("direct_solve", _B)(_named("direct"))


@query("pcg_jacobi", _B)
def pcg_jacobi(spark, sf):
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    return _applied_back(k, krylov.pcg(ws, k, b, "jacobi", rel_tol=1e-8).checked())


@query("direct_lu", with_(LOAD) + "SELECT i, v FROM b")
def direct_lu(spark, sf):
    """An unsymmetric system: K with twice the weight below the diagonal."""
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    v = F.when(F.col("j") < F.col("i"), 0.5 * F.col("v")).otherwise(F.col("v"))
    a = SparseMatrix(k.df.withColumn("v", v), k.nrows, k.ncols)
    return _applied_back(a, solvers.DirectSolver(ws, a).solve(b))


@query("direct_indefinite", _B)
def direct_indefinite(spark, sf):
    """K − 2.7·I has eigenvalues of both signs."""
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    v = F.when(F.col("i") == F.col("j"), F.col("v") - 2.7).otherwise(F.col("v"))
    a = SparseMatrix(k.df.withColumn("v", v), k.nrows, k.ncols)
    return _applied_back(a, solvers.DirectSolver(ws, a, "indefinite", max_iter_ref=2).solve(b))


@query("direct_inertia", """
WITH p AS (
  SELECT c_custkey // 2 AS block, max(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END) AS a,
         max(CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END) AS b
  FROM customer GROUP BY 1),
n AS (
  SELECT CASE WHEN b IS NULL THEN CAST(a < 0 AS INT) WHEN a * b < 250000 THEN 1 WHEN a < 0 THEN 2 ELSE 0 END AS negative,
         CASE WHEN b IS NULL THEN 1 ELSE 2 END AS size
  FROM p)
SELECT CAST(sum(negative) AS BIGINT) AS negative, CAST(sum(size) - sum(negative) AS BIGINT) AS others FROM n""")
def direct_inertia(spark, sf):
    """Balances of pairs of customers as blocks (a, 500; 500, b): the signs of
    their eigenvalues follow from determinant and trace."""
    ws, n = Workspace(spark), src.customers(spark, sf)
    balance = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_custkey").alias("j"), F.col("c_acctbal").cast("double").alias("v"))
    other = F.col("i").bitwiseXOR(F.lit(1)).alias("j")
    coupled = balance.select("i", other, F.lit(500.0).alias("v")).where(F.col("j") < n)
    a = SparseMatrix(balance.unionAll(coupled), n, n)
    negative, others = solvers.DirectSolver(ws, a, "indefinite").inertia
    return spark.createDataFrame([(negative, others)], "negative long, others long")


@query("gmres_unsymmetric", _B)
def gmres_unsymmetric(spark, sf):
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    v = F.when(F.col("j") < F.col("i"), 0.5 * F.col("v")).otherwise(F.col("v"))
    a = SparseMatrix(k.df.withColumn("v", v), k.nrows, k.ncols)
    return _applied_back(a, krylov.fgmres(ws, a, b, restart=8, rel_tol=1e-8).checked())


_JACOBI = with_(STIFF, LOAD) + """,
d AS (SELECT i, v AS d FROM k WHERE i = j),
x0 AS (SELECT i, CAST(0 AS DOUBLE) AS v FROM b)"""
for _s in range(1, 4):
    _JACOBI += f""",
x{_s} AS (SELECT b.i, x.v + 0.8 * (b.v - s.s) / d.d AS v
  FROM b JOIN d ON b.i = d.i JOIN x{_s - 1} x ON b.i = x.i
  JOIN (SELECT k.i, sum(k.v * y.v) AS s FROM k JOIN x{_s - 1} y ON k.j = y.i GROUP BY 1) s ON s.i = b.i)"""


@query("weighted_jacobi", _JACOBI + " SELECT i, round(v, 6) AS v FROM x3")
def weighted_jacobi(spark, sf):
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    zero = Vector(b.df.select("i", F.lit(0.0).alias("v")), b.n)
    return krylov.weighted_jacobi(ws, k, b, zero, 0.8, 3).df.select("i", F.round("v", 6).alias("v"))


_POWER = with_(STIFF, LOAD) + ", x0 AS (SELECT i, v FROM b)"
for _s in range(1, 5):
    _POWER += f", x{_s} AS (SELECT k.i, sum(k.v * x.v) AS v FROM k JOIN x{_s - 1} x ON k.j = x.i GROUP BY 1)"
_POWER += """,
p AS (SELECT sum(a.v * b.v) / sum(a.v * a.v) AS value FROM x3 a JOIN x4 b ON a.i = b.i),
n AS (SELECT sqrt(sum(v * v)) AS norm FROM x4)"""


@query("power_steps", _POWER + " SELECT i, round(v / norm, 6) + 0 AS v FROM x4, n")
def power_steps(spark, sf):
    """The normalised iterate after four steps."""
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    x = eigen.power_iteration(ws, k, b, max_iters=4, tol=0.0).vector
    return x.df.select("i", (F.round("v", 6) + 0.0).alias("v"))


@query("power_value", _POWER + " SELECT round(value, 6) AS value FROM p")
def power_value(spark, sf):
    """The Rayleigh quotient of the fourth step."""
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    pair = eigen.power_iteration(ws, k, b, max_iters=4, tol=0.0)
    return src.table(spark, sf, "region").agg(F.round(F.lit(pair.value), 6).alias("value"))


@query("inverse_power", with_(LOAD) + "SELECT count(*) AS n, CAST(1 AS DOUBLE) AS value FROM b")
def inverse_power(spark, sf):
    """The smallest eigenvalue of a graph Laplacian plus the identity is 1."""
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    pair = eigen.power_iteration(ws, k, b, which="S", tol=1e-3)
    return pair.vector.df.agg(F.count(F.lit(1)).alias("n"), F.round(F.lit(pair.value), 3).alias("value"))


def _start(spark, sf) -> Vector:
    n = src.customers(spark, sf)
    rows = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("i"))
    return generators.random_vector(rows, n, seed=17, low=-1.0, high=1.0)


@query("lanczos_largest", with_(LOAD) + "SELECT count(*) AS n, true AS accurate FROM b")
def lanczos_largest(spark, sf):
    ws, k = Workspace(spark), src.stiffness(spark, sf)
    pair = eigen.lanczos(ws, k, _start(spark, sf), ncv=24)[0]
    return _accuracy(ws, k, pair)


def _accuracy(ws, k, pair, mass=None):
    saved = eigen.EigenPair(pair.value, Vector(ws.save(pair.vector.df).df, pair.vector.n), pair.iterations, pair.converged)
    res = eigen.eigen_residual(k, saved, mass).first()["residual"]
    return saved.vector.df.agg(F.count(F.lit(1)).alias("n"), F.lit(bool(res < 1e-3 * abs(pair.value))).alias("accurate"))


@query("lanczos_mass", with_(LOAD) + "SELECT count(*) AS n, true AS accurate FROM b")
def lanczos_mass(spark, sf):
    """K·v = λ·M·v with the load as a diagonal mass."""
    ws, k, mass = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    pair = eigen.lanczos(ws, k, _start(spark, sf), ncv=24, mass=mass)[0]
    return _accuracy(ws, k, pair, mass)


@query("eigen_restarted", "SELECT count(*) * 0 + 4 AS pairs, true AS accurate, true AS narrow FROM customer")
def eigen_restarted(spark, sf):
    """Four largest pairs with never more than twelve vectors."""
    ws, k = Workspace(spark), src.stiffness(spark, sf)
    solver = krylov_schur.KrylovSchur(ws, k, nev=4, ncv=12)
    pairs = solver.run(_start(spark, sf))
    accurate = all(krylov_schur.general_residual(k, p) < 1e-3 for p in pairs)
    return spark.createDataFrame([(len(pairs), accurate, solver.widest <= 12)], "pairs long, accurate boolean, narrow boolean")


@query("lanczos_mass_matrix", with_(LOAD) + "SELECT count(*) AS n, true AS accurate FROM b")
def lanczos_mass_matrix(spark, sf):
    """K·v = λ·M·v where M couples the rows that K does."""
    ws, k = Workspace(spark), src.stiffness(spark, sf)
    v = 0.01 * F.col("v") + F.when(F.col("i") == F.col("j"), 0.99).otherwise(0.0)
    m = SparseMatrix(k.df.withColumn("v", v), k.nrows, k.ncols, positive_definite=True)
    pair = krylov_schur.KrylovSchur(ws, k, m, ncv=6, tol=1e-3).run(_start(spark, sf))[0]
    pair = eigen.EigenPair(pair.value, Vector(ws.save(pair.vector.df).df, k.nrows), pair.iterations, pair.converged)
    accurate = krylov_schur.general_residual(k, pair, m) < 1e-2
    return pair.vector.df.agg(F.count(F.lit(1)).alias("n"), F.lit(accurate).alias("accurate"))


@query("eigen_resumed", with_(LOAD) + "SELECT count(*) AS n, true AS equal FROM b")
def eigen_resumed(spark, sf):
    """Stopped after one restart, gone on with from its folder, and uninterrupted."""
    ws, k = Workspace(spark), src.stiffness(spark, sf)
    state = ws.new_path("state")
    make = lambda state: krylov_schur.KrylovSchur(ws, k, nev=1, ncv=4, tol=1e-3, state=state)
    make(state).run(_start(spark, sf), max_restarts=1, partial=True)
    late, whole = make(state).run(_start(spark, sf)), make(None).run(_start(spark, sf))
    equal = all(abs(x.value - y.value) <= 1e-9 * abs(y.value) for x, y in zip(late, whole)) and late[0].iterations == whole[0].iterations
    return late[0].vector.df.agg(F.count(F.lit(1)).alias("n"), F.lit(equal).alias("equal"))


@query("lanczos_shift_invert", with_(LOAD) + "SELECT count(*) AS n, CAST(1 AS DOUBLE) AS value FROM b")
def lanczos_shift_invert(spark, sf):
    """The eigenvalue nearest to zero, through the inverse."""
    ws, k = Workspace(spark), src.stiffness(spark, sf)
    pair = eigen.lanczos(ws, k, _start(spark, sf), ncv=5, shift=0.0)[0]
    return pair.vector.df.agg(F.count(F.lit(1)).alias("n"), F.round(F.lit(pair.value), 3).alias("value"))


@query("orthonormalize", with_(CELLS) + """
SELECT a.j AS i, b.j, CASE WHEN a.j = b.j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v
FROM (SELECT DISTINCT j FROM e) a, (SELECT DISTINCT j FROM e) b""")
def orthonormalize(spark, sf):
    """QᵀQ of the embedding columns is the identity."""
    q = eigen.orthonormalize(Workspace(spark), src.embedding_matrix(spark, sf))
    g = products.dense_product(q, q, trans_a=True).df
    return g.select("i", "j", (F.abs(F.round("v", 9)) + 0.0).alias("v"))


@query("orthonormal_span", with_(CELLS) + "SELECT i, j, round(v, 6) + 0 AS v FROM e")
def orthonormal_span(spark, sf):
    """Q·(QᵀA) gives back A."""
    ws, a = Workspace(spark), src.embedding_matrix(spark, sf)
    q = eigen.orthonormalize(ws, a)
    q = type(q)(ws.save(q.df).df, q.nrows, q.ncols)
    back = products.dense_product(q, products.dense_product(q, a, trans_a=True)).df
    return back.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("reorder_scale_solve", _B)
def reorder_scale_solve(spark, sf):
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    return _applied_back(k, pipelines.reorder_scale_solve(ws, k, b, "cg", rel_tol=1e-11))


def _regions(spark, sf) -> SparseMatrix:
    """customer × region indicator: the ports."""
    c = src.table(spark, sf, "customer").join(src.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    df = c.select(F.col("c_custkey").alias("i"), F.col("n_regionkey").cast("bigint").alias("j"), F.lit(1.0).alias("v"))
    return SparseMatrix(df, src.customers(spark, sf), src.key_span(spark, sf, "region", "r_regionkey"))


def _mass(spark, sf) -> SparseMatrix:
    df = src.customer_load(spark, sf).df.select("i", F.col("i").alias("j"), "v")
    n = src.customers(spark, sf)
    return SparseMatrix(df, n, n)


@query("mor_solutions", """
SELECT n_regionkey * 5 + f AS sys, c_custkey AS i, CAST(1 AS DOUBLE) AS v
FROM customer JOIN nation ON c_nationkey = n_nationkey, range(5) t(f)""")
def mor_solutions(spark, sf):
    """(f·M + K)·x of every system gives back its port column."""
    ws, k, m = Workspace(spark), src.stiffness(spark, sf), _mass(spark, sf)
    x = pipelines.shifted_solves(ws, k, m, _regions(spark, sf), pipelines.frequencies(1.0, 3.0))
    known = x.select("sys", "f", F.col("i").alias("j"), F.col("v").alias("x"))
    kx = k.df.join(known, "j").select("sys", "i", (F.col("v") * F.col("x")).alias("t"))
    mx = m.df.join(known, "j").select("sys", "i", (F.col("f") * F.col("v") * F.col("x")).alias("t"))
    back = kx.union(mx).groupBy("sys", "i").agg(F.round(F.sum("t"), 5).alias("v"))
    return back.where("abs(v) > 0").select("sys", "i", "v")


def _reduced(part: str):
    def run(spark, sf):
        ws, k, m = Workspace(spark), src.stiffness(spark, sf), _mass(spark, sf)
        out = pipelines.reduce_model(ws, k, m, _regions(spark, sf), 1.0, 3.0)[part].df
        return out.select("i", "j", F.round("v", 4).alias("v"))

    return run


query("mor_reduce_k")(_reduced("K"))
query("mor_reduce_g")(_reduced("G"))

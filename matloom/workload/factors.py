"""Triangular solve and factorisation queries.

Numeric factors are checked by reconstruction: the product of the factors must
give back the matrix on its own pattern, and a solve must give back the load.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matloom.model import SparseMatrix, Vector
from matloom.operators import factor, fill, products, structure, triangular
from matloom.runtime import Workspace
from matloom.sources import tables as src
from matloom.workload.registry import query
from matloom.workload.sqltext import ARCS, LOAD, STIFF, with_

_B = with_(LOAD) + "SELECT i, v FROM b"


def _rounded(x: Vector):
    return x.df.select("i", (F.round("v", 6) + 0.0).alias("v"))


def _times_unit_lower(k, x: Vector) -> Vector:
    strict = structure.strict_lower(k)
    return products.matvec(strict, x, 1.0, 1.0, x)


@query("fwd_solve", _B)
def fwd_solve(spark, sf):
    """(I + L)·x after solving (I + L)·x = b."""
    k, b = src.stiffness(spark, sf), src.customer_load(spark, sf)
    x = triangular.forward_substitution(Workspace(spark), structure.strict_lower(k), b)
    return _rounded(_times_unit_lower(k, x))


@query("fwd_solve_t", _B)
def fwd_solve_t(spark, sf):
    k, b = src.stiffness(spark, sf), src.customer_load(spark, sf)
    upper = structure.transpose(structure.strict_lower(k))
    x = triangular.forward_substitution_transposed(Workspace(spark), upper, b)
    return _rounded(_times_unit_lower(k, x))


@query("bwd_solve", _B)
def bwd_solve(spark, sf):
    """(D + U)·x after solving (D + U)·x = b."""
    k, b = src.stiffness(spark, sf), src.customer_load(spark, sf)
    x = triangular.backward_substitution(Workspace(spark), structure.strict_upper(k), structure.diagonal(k), b)
    return _rounded(products.matvec(structure.upper_triangle(k), x))


_FORWARD = "WITH RECURSIVE " + ARCS.strip() + """,
low AS (SELECT src AS i, dst AS j FROM arcs WHERE dst < src),
paths AS (
  SELECT c_custkey AS id, c_custkey AS start, 0 AS hops FROM customer
  UNION ALL SELECT low.i, start, hops + 1 FROM paths JOIN low ON low.j = id)
SELECT id AS i, CAST(sum(start % 7 + 1) AS DOUBLE) AS v FROM paths GROUP BY 1"""


@query("fwd_solution", _FORWARD)
def fwd_solution(spark, sf):
    """The solution itself: with L = −1 on links, x sums the load over all
    ascending link paths that end in a row."""
    k, b = src.stiffness(spark, sf), src.customer_load(spark, sf)
    return triangular.forward_substitution(Workspace(spark), structure.strict_lower(k), b).df


@query("fwd_sweeps", _FORWARD)
def fwd_sweeps(spark, sf):
    k, b = src.stiffness(spark, sf), src.customer_load(spark, sf)
    return triangular.TriangularSolve(Workspace(spark), structure.strict_lower(k), "lower").sweep(b).df


@query("fwd_contracted", _FORWARD)
def fwd_contracted(spark, sf):
    k, b = src.stiffness(spark, sf), src.customer_load(spark, sf)
    return triangular.ContractedSolve(Workspace(spark), structure.strict_lower(k), "lower").solve(b).df


@query("chain_solve", with_(LOAD) + """
SELECT x.i, round(sum(y.v * CASE WHEN (x.i - y.i) % 2 = 0 THEN 1 ELSE -1 END / power(2, x.i - y.i)), 6) + 0.0 AS v
FROM b x JOIN b y ON y.i BETWEEN x.i - 60 AND x.i GROUP BY 1""")
def chain_solve(spark, sf):
    """Half of each row's predecessor is taken from it: one chain of all customers,
    solved in as many rounds as their number has binary digits."""
    ws, n, b = Workspace(spark), src.customers(spark, sf), src.customer_load(spark, sf)
    cells = spark.range(1, n).select(F.col("id").alias("i"), (F.col("id") - 1).alias("j"), F.lit(0.5).alias("v"))
    x = triangular.ContractedSolve(ws, SparseMatrix(cells, n, n), "lower").solve(b)
    return x.df.select("i", (F.round("v", 6) + 0.0).alias("v"))


def _ic_sql(k: int) -> str:
    """The level rule unrolled k times."""
    text = with_(STIFF) + ", f0 AS (SELECT i, j, 0 AS level FROM k WHERE i <= j)"
    for r in range(1, k + 1):
        p = f"f{r - 1}"
        text += f""",
f{r} AS (SELECT i, j, min(level) AS level FROM (
  SELECT i, j, level FROM {p} UNION ALL
  SELECT a.j, b.j, a.level + b.level + 1 FROM {p} a JOIN {p} b ON a.i = b.i
  WHERE a.i < a.j AND b.i < b.j AND a.j <= b.j AND a.level + b.level + 1 <= {k}) GROUP BY 1, 2)"""
    return text + f" SELECT i, j, level FROM f{k}"


def _ilu_sql(k: int) -> str:
    text = with_(STIFF) + ", f0 AS (SELECT i, j, 0 AS level FROM k)"
    for r in range(1, k + 1):
        p = f"f{r - 1}"
        text += f""",
f{r} AS (SELECT i, j, min(level) AS level FROM (
  SELECT i, j, level FROM {p} UNION ALL
  SELECT a.i, b.j, a.level + b.level + 1 FROM {p} a JOIN {p} b ON a.j = b.i
  WHERE a.j < a.i AND b.j > b.i AND a.level + b.level + 1 <= {k}) GROUP BY 1, 2)"""
    return text + f" SELECT i, j, level FROM f{k}"


def _ic(k: int):
    def run(spark, sf):
        return fill.ic_pattern(Workspace(spark), src.stiffness(spark, sf).df, k)

    return run


def _ilu(k: int):
    def run(spark, sf):
        return fill.ilu_pattern(Workspace(spark), src.stiffness(spark, sf).df, k)

    return run


for _k in (0, 1, 3):
    query(f"ic_symbolic_k{_k}", _ic_sql(_k))(_ic(_k))
for _k in (1, 2):
    query(f"ilu_symbolic_k{_k}", _ilu_sql(_k))(_ilu(_k))


@query("complete_fill", "WITH RECURSIVE " + ARCS.strip() + """,
reach AS (SELECT c_custkey AS root, c_custkey AS x FROM customer
          UNION SELECT root, dst FROM reach JOIN arcs ON src = x WHERE dst < root)
SELECT DISTINCT root AS i, dst AS j FROM reach JOIN arcs ON src = x WHERE dst > root
UNION ALL SELECT c_custkey, c_custkey FROM customer""")
def complete_fill(spark, sf):
    k = src.stiffness(spark, sf)
    return fill.complete_pattern(Workspace(spark), k.df, spark.range(k.nrows))


def _product_on_pattern(k, f):
    """Factor product at the cells of K."""
    both = factor.factor_product(f)
    cells = k.df.select("i", "j")
    return both.join(cells, ["i", "j"], "left_semi").select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


_K = with_(STIFF) + "SELECT i, j, v FROM k"


@query("ic0_product", _K)
def ic0_product(spark, sf):
    """UᵀU agrees with K on K's own pattern."""
    k = src.stiffness(spark, sf)
    return _product_on_pattern(k, factor.incomplete_cholesky(Workspace(spark), k, 0))


@query("ic1_product", _K)
def ic1_product(spark, sf):
    k = src.stiffness(spark, sf)
    return _product_on_pattern(k, factor.incomplete_cholesky(Workspace(spark), k, 1))


_DIAGONAL = with_(STIFF) + "SELECT i, j, CASE WHEN i = j THEN {} ELSE v END AS v FROM k"


@query("ic0_omega", _DIAGONAL.format("1.5 * v"))
def ic0_omega(spark, sf):
    """With omega 0.5 the factor stands for K with its diagonal times 1.5."""
    k = src.stiffness(spark, sf)
    return _product_on_pattern(k, factor.incomplete_cholesky(Workspace(spark), k, 0, omega=0.5))


def _lowered(k):
    """K with its diagonal cut to a tenth: pivots fail until a shift lifts them."""
    v = F.when(F.col("i") == F.col("j"), 0.1 * F.col("v")).otherwise(F.col("v"))
    return k.with_entries(k.df.withColumn("v", v))


def _shift_query(mode: str, first: float):
    def run(spark, sf):
        k = src.stiffness(spark, sf)
        f = factor.incomplete_cholesky(Workspace(spark), _lowered(k), 0, shift_mode=mode, first_shift=first)
        d = 0.1 * F.col("k.v")
        moved = d * (1 + f.shift) if mode == "mul" else d + F.lit(f.shift)
        got = factor.factor_product(f).alias("f").join(k.df.alias("k"), ["i", "j"])
        want = F.when(F.col("i") == F.col("j"), moved).otherwise(F.col("k.v"))
        return got.select("i", "j", (F.abs(F.col("f.v") - want) < 1e-6).alias("agrees"))

    return run


_AGREES = with_(STIFF) + "SELECT i, j, true AS agrees FROM k"
query("ic0_shift_add", _AGREES)(_shift_query("add", 0.5))
query("ic0_shift_mul", _AGREES)(_shift_query("mul", 2.0))


@query("ilu0_repair", _DIAGONAL.format("CASE WHEN v < 3 THEN 3 ELSE v END"))
def ilu0_repair(spark, sf):
    """Diagonals below 3 are replaced by 3 before the elimination."""
    k = src.stiffness(spark, sf)
    return _product_on_pattern(k, factor.incomplete_lu(Workspace(spark), k, 0, repair=(3.0, 3.0)))


@query("ilu0_product", _K)
def ilu0_product(spark, sf):
    k = src.stiffness(spark, sf)
    return _product_on_pattern(k, factor.incomplete_lu(Workspace(spark), k, 0))


@query("ilu2_product", _K)
def ilu2_product(spark, sf):
    k = src.stiffness(spark, sf)
    return _product_on_pattern(k, factor.incomplete_lu(Workspace(spark), k, 2))


@query("ilut_product", _K)
def ilut_product(spark, sf):
    """With no threshold and room for every entry ILUT is a complete LU."""
    k = src.stiffness(spark, sf)
    f = factor.incomplete_lu_threshold(Workspace(spark), k, tau=0.0, max_fill=k.nrows)
    return _product_on_pattern(k, f)


@query("ilut_row_sizes", with_(STIFF) + "SELECT count(*) AS n, true AS within FROM customer")
def ilut_row_sizes(spark, sf):
    """Default knobs: at most two entries per row in each triangle."""
    k = src.stiffness(spark, sf)
    m = factor.incomplete_lu_threshold(Workspace(spark), k).matrix.df
    rows = m.groupBy("i").agg(F.count_if(F.col("j") < F.col("i")).alias("l"), F.count_if(F.col("j") > F.col("i")).alias("u"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("l") <= 2) & (F.col("u") <= 2)).alias("within"))


@query("ic_memory_product", _K)
def ic_memory_product(spark, sf):
    """With room for all fill the factor is complete."""
    k = src.stiffness(spark, sf)
    f = factor.cholesky_with_memory(Workspace(spark), k, lsize=k.nrows)
    return _product_on_pattern(k, f)


@query("ic_memory_rows", with_(STIFF) + """
SELECT i, true AS within FROM k WHERE i <= j GROUP BY 1""")
def ic_memory_rows(spark, sf):
    """No row of U holds more than its original count plus one."""
    k = src.stiffness(spark, sf)
    f = factor.cholesky_with_memory(Workspace(spark), k, lsize=1, rsize=2)
    before = k.df.where("i <= j").groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    after = f.matrix.df.groupBy("i").agg(F.count(F.lit(1)).alias("m"))
    return before.join(after, "i").select("i", (F.col("m") <= F.col("n") + 1).alias("within"))


@query("ic_apply", _B)
def ic_apply(spark, sf):
    """K·z after z = (UᵀU)⁻¹ b with the complete factor."""
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    z = factor.FactorSolve(ws, factor.complete_cholesky(ws, k))(b)
    return _rounded(products.matvec(k, z))


@query("ilu_apply", _B)
def ilu_apply(spark, sf):
    ws, k, b = Workspace(spark), src.stiffness(spark, sf), src.customer_load(spark, sf)
    z = factor.FactorSolve(ws, factor.complete_lu(ws, k))(b)
    return _rounded(products.matvec(k, z))

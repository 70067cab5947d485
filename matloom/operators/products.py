"""Products: equi-joins on the inner index followed by a grouped sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.model import DenseMatrix, SparseMatrix, Vector, index


def _multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """Σ_k left(i,k)·right(k,j); partial sums form before the shuffle on (i, j)."""
    a = left.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    b = right.select(F.col("i").alias("k"), "j", F.col("v").alias("bv"))
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("av") * F.col("bv")).alias("v"))


def _flip(df: DataFrame, on: bool) -> DataFrame:
    return df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v") if on else df


def matvec(
    a: SparseMatrix,
    b: Vector,
    alpha: float = 1.0,
    beta: float = 0.0,
    x: Vector | None = None,
    trans: bool = False,
) -> Vector:
    """α·op(A)·b + β·x; x is not read when β is 0."""
    entries = _flip(a.entries(), trans)
    n = a.ncols if trans else a.nrows
    factor = b.df.select(F.col("i").alias("j"), F.col("v").alias("bv"))
    sums = entries.join(factor, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("bv")).alias("s"))
    value = F.lit(alpha) * F.coalesce("s", F.lit(0.0))
    if beta == 0.0:
        rows = index(a.spark, n).join(sums, "i", "left")
    else:
        rows = x.df.withColumnRenamed("v", "xv").join(sums, "i", "left")
        value = value + F.lit(beta) * F.col("xv")
    return Vector(rows.select("i", value.alias("v")), n)


def matmul(a: SparseMatrix, b: SparseMatrix, trans_a: bool = False, trans_b: bool = False) -> SparseMatrix:
    """op(A)·op(B).  AQE splits inner indices that are skewed on either side."""
    nrows, inner_a = (a.ncols, a.nrows) if trans_a else (a.nrows, a.ncols)
    inner_b, ncols = (b.ncols, b.nrows) if trans_b else (b.nrows, b.ncols)
    if inner_a != inner_b:
        raise ValueError(f"inner sizes differ: {inner_a} and {inner_b}")
    df = _multiply(_flip(a.entries(), trans_a), _flip(b.entries(), trans_b))
    return SparseMatrix(df, nrows, ncols)


def ptap(a: SparseMatrix, p: SparseMatrix) -> SparseMatrix:
    """Pᵀ·A·P; a symmetric A gives the upper triangle of the result."""
    full = matmul(p, matmul(a, p), trans_a=True)
    return _keep_symmetry(a, full)


def papt(a: SparseMatrix, p: SparseMatrix) -> SparseMatrix:
    """P·A·Pᵀ; a symmetric A gives the upper triangle of the result."""
    full = matmul(matmul(p, a), p, trans_b=True)
    return _keep_symmetry(a, full)


def _keep_symmetry(a: SparseMatrix, full: SparseMatrix) -> SparseMatrix:
    if a.structure != "sym_upper":
        return full
    return full.with_entries(full.df.where("j >= i"), structure="sym_upper")


def sparse_dense(a: SparseMatrix, b: DenseMatrix, trans_a: bool = False) -> DenseMatrix:
    """op(A)·B with every cell of the result present."""
    nrows, inner = (a.ncols, a.nrows) if trans_a else (a.nrows, a.ncols)
    if inner != b.nrows:
        raise ValueError(f"inner sizes differ: {inner} and {b.nrows}")
    sums = _multiply(_flip(a.entries(), trans_a), b.df)
    return _fill(a, sums, nrows, b.ncols)


def _fill(a: SparseMatrix, sums: DataFrame, nrows: int, ncols: int) -> DenseMatrix:
    grid = index(a.spark, nrows).withColumn("j", F.explode(F.expr(f"slice(sequence(0L, {max(ncols - 1, 0)}L), 1, {ncols})")))
    df = grid.join(sums, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
    return DenseMatrix(df, nrows, ncols)


def dense_product(a: DenseMatrix, b: DenseMatrix, trans_a: bool = False, trans_b: bool = False) -> DenseMatrix:
    nrows, inner_a = (a.ncols, a.nrows) if trans_a else (a.nrows, a.ncols)
    inner_b, ncols = (b.ncols, b.nrows) if trans_b else (b.nrows, b.ncols)
    if inner_a != inner_b:
        raise ValueError(f"inner sizes differ: {inner_a} and {inner_b}")
    return DenseMatrix(_multiply(_flip(a.df, trans_a), _flip(b.df, trans_b)), nrows, ncols)


def dense_ptap(a: SparseMatrix, p: DenseMatrix) -> DenseMatrix:
    return dense_product(p, sparse_dense(a, p), trans_a=True)


def dense_papt(a: SparseMatrix, p: DenseMatrix) -> DenseMatrix:
    """P·A·Pᵀ as (A·Pᵀ) multiplied by P from the left; A is square."""
    p_t = DenseMatrix(_flip(p.df, True), p.ncols, p.nrows)
    return dense_product(p, sparse_dense(a, p_t))


def diagonal_times_vector(d: Vector, x: Vector, alpha: float = 1.0, beta: float = 0.0, y: Vector | None = None) -> Vector:
    """α·d∘x + β·y."""
    rows = d.df.withColumnRenamed("v", "dv").join(x.df.withColumnRenamed("v", "xv"), "i")
    value = F.lit(alpha) * F.col("dv") * F.col("xv")
    if beta != 0.0:
        rows = rows.join(y.df.withColumnRenamed("v", "yv"), "i")
        value = value + F.lit(beta) * F.col("yv")
    return Vector(rows.select("i", value.alias("v")), d.n)

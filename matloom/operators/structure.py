"""Projections, filters and index rewrites of sparse matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.functions.scan import dense_position, running_sum
from matloom.model import DenseMatrix, Permutation, SparseMatrix, Vector, index
from matloom.runtime import Workspace

_MIRROR = {"general": "general", "lower": "upper", "upper": "lower", "sym_upper": "sym_upper"}


def transpose(a: SparseMatrix) -> SparseMatrix:
    if a.structure == "sym_upper":
        return a
    df = a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return SparseMatrix(df, a.ncols, a.nrows, _MIRROR[a.structure], a.positive_definite)


def prune(a: SparseMatrix, tol: float = 1e-16) -> SparseMatrix:
    """Keep entries whose magnitude exceeds ``tol``."""
    return a.with_entries(a.df.where(F.abs("v") > tol))


def strict_lower(a: SparseMatrix) -> SparseMatrix:
    return a.with_entries(a.df.where("j < i"), structure="lower")


def strict_upper(a: SparseMatrix) -> SparseMatrix:
    return a.with_entries(a.df.where("j > i"), structure="upper")


def lower_triangle(a: SparseMatrix) -> SparseMatrix:
    return a.with_entries(a.df.where("j <= i"), structure="lower")


def upper_triangle(a: SparseMatrix) -> SparseMatrix:
    return a.with_entries(a.df.where("j >= i"), structure="upper")


def split_ldu(a: SparseMatrix) -> tuple[SparseMatrix, Vector, SparseMatrix]:
    return strict_lower(a), diagonal(a), strict_upper(a)


def to_symmetric(a: SparseMatrix) -> SparseMatrix:
    """Keep one triangle of a symmetric matrix."""
    return a.with_entries(a.df.where("j >= i"), structure="sym_upper")


def to_full(a: SparseMatrix) -> SparseMatrix:
    """Mirror the stored upper triangle: U + Uᵀ − D."""
    half = a.with_entries(a.df, structure="sym_upper")
    return a.with_entries(half.entries(), structure="general")


def block(a: SparseMatrix, i: int, j: int, p: int, q: int) -> SparseMatrix:
    """Rows [i, i+p) and columns [j, j+q), renumbered from zero."""
    if i + p > a.nrows:
        raise ValueError(f"rows {i}..{i + p} leave a matrix of {a.nrows} rows")
    q = min(q, a.ncols - j)
    inside = (F.col("i") >= i) & (F.col("i") < i + p) & (F.col("j") >= j) & (F.col("j") < j + q)
    df = a.entries().where(inside).select((F.col("i") - i).alias("i"), (F.col("j") - j).alias("j"), "v")
    return SparseMatrix(df, p, q)


def diagonal(a: SparseMatrix, invert: bool = False) -> Vector:
    """The diagonal with 0 where none is stored; inverted, 0 becomes 1."""
    stored = a.df.where("i = j").select("i", "v")
    value = F.coalesce("v", F.lit(0.0))
    if invert:
        value = F.when(value == 0.0, 1.0).otherwise(1.0 / value)
    n = min(a.nrows, a.ncols)
    return Vector(index(a.spark, n).join(stored, "i", "left").select("i", value.alias("v")), n)


def diagonal_positions(ws: Workspace, a: SparseMatrix) -> DataFrame:
    """``(i, pos)``: where each stored diagonal entry sits in row-major order."""
    per_row = a.df.groupBy("i").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("j") < F.col("i")).alias("before"),
        F.count_if(F.col("j") == F.col("i")).alias("has"),
    )
    total = running_sum(ws, per_row, [F.col("i")], "n", "upto")
    return total.where("has > 0").select("i", (F.col("upto") - F.col("n") + F.col("before")).alias("pos"))


def diagonal_complete(a: SparseMatrix) -> DataFrame:
    """One row: rows, stored diagonal entries, and whether none is missing."""
    n = min(a.nrows, a.ncols)
    return a.df.where("i = j").agg(F.count(F.lit(1)).alias("stored")).select(
        F.lit(n).cast("bigint").alias("n"), "stored", (F.col("stored") == n).alias("complete")
    )


def without_self_loops(a: SparseMatrix) -> DataFrame:
    """Adjacency arcs ``(src, dst)`` of the pattern."""
    return a.edges().where("src <> dst")


def row_pointer(ws: Workspace, a: SparseMatrix, base: int = 0) -> DataFrame:
    """``(i, ptr)`` for i = 0..nrows: entries stored before row i, plus base."""
    counts = a.df.groupBy((F.col("i") + 1).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return _pointer(ws, counts, a.spark.range(a.nrows + 1), base)


def permuted_row_pointer(ws: Workspace, a: SparseMatrix, rows: Permutation | None, base: int = 0) -> DataFrame:
    """Row pointer after moving old row ``old_id`` to ``new_id``."""
    return row_pointer(ws, permute(a, rows, None), base)


def _pointer(ws: Workspace, counts: DataFrame, ids: DataFrame, base: int) -> DataFrame:
    all_rows = ids.select(F.col("id").alias("i")).join(counts, "i", "left").select(
        "i", F.coalesce("n", F.lit(0)).alias("n")
    )
    total = running_sum(ws, all_rows, [F.col("i")], "n", "ptr")
    return total.select("i", (F.col("ptr") + base).alias("ptr"))


def to_csr(ws: Workspace, a: SparseMatrix, base: int = 0) -> tuple[DataFrame, DataFrame]:
    """Row pointers ``(i, ptr)`` and row-major ``(pos, j, v)``, counted from ``base``."""
    placed = dense_position(ws, a.df, [F.col("i"), F.col("j")], "pos")
    return row_pointer(ws, a, base), placed.select((F.col("pos") + base).alias("pos"), (F.col("j") + base).alias("j"), "v")


def from_csr(ws: Workspace, ptr: DataFrame, body: DataFrame, nrows: int, ncols: int, base: int = 0) -> SparseMatrix:
    """The matrix of row pointers ``(i, ptr)``, i = 0..nrows, and ``(pos, j, v)``.

    An entry's row is the number of later rows that begin at or before it.
    """
    none = F.lit(None)
    begins = ptr.where("i >= 1").select(
        F.col("ptr").alias("pos"), F.lit(0).alias("kind"), "i", none.cast("long").alias("j"), none.cast("double").alias("v"),
        F.lit(1).cast("long").alias("step"),
    )
    entries = body.select("pos", F.lit(1), F.lit(0).cast("long"), F.col("j") - base, "v", F.lit(0).cast("long"))
    counted = running_sum(ws, begins.union(entries), [F.col("pos"), F.col("kind"), F.col("i")], "step", "row")
    return SparseMatrix(counted.where("kind = 1").select(F.col("row").alias("i"), "j", "v"), nrows, ncols)


def shift_base(a: SparseMatrix, base: int) -> DataFrame:
    """Entries with indices counted from ``base``, for export."""
    return a.df.select((F.col("i") + base).alias("i"), (F.col("j") + base).alias("j"), "v")


def _renumber(df: DataFrame, column: str, p: Permutation | None) -> DataFrame:
    if p is None:
        return df
    table = p.df.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    return df.join(table, column).withColumn(column, F.col("_new")).drop("_new")


def permute(a: SparseMatrix, rows: Permutation | None, cols: Permutation | None) -> SparseMatrix:
    """Move old rows and columns to their new positions; None keeps the order."""
    df = _renumber(_renumber(a.entries(), "i", rows), "j", cols)
    return SparseMatrix(df.select("i", "j", "v"), a.nrows, a.ncols)


def symmetric_permute(a: SparseMatrix, p: Permutation) -> SparseMatrix:
    """Upper triangle of P A Pᵀ from the upper triangle of A."""
    moved = _renumber(_renumber(a.df.where("j >= i"), "i", p), "j", p)
    df = moved.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v")
    return a.with_entries(df, structure="sym_upper")


def permute_vector(x: Vector, p: Permutation) -> Vector:
    return Vector(_renumber(x.df, "i", p).select("i", "v"), x.n)


def permutation_check(p: Permutation) -> DataFrame:
    """One row telling whether both columns run through 0..n-1 exactly once."""
    seen = p.df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("new_id").alias("news"),
        F.count_distinct("old_id").alias("olds"),
        F.min(F.least("new_id", "old_id")).alias("lo"),
        F.max(F.greatest("new_id", "old_id")).alias("hi"),
    )
    ok = (
        (F.col("n") == p.n) & (F.col("news") == p.n) & (F.col("olds") == p.n)
        & (F.col("lo") == 0) & (F.col("hi") == p.n - 1)
    )
    return seen.select("n", ok.alias("valid"))


def scale_two_sided(a: SparseMatrix, d: Vector) -> SparseMatrix:
    """v ← d_i · v · d_j."""
    left = d.df.select("i", F.col("v").alias("di"))
    right = d.df.select(F.col("i").alias("j"), F.col("v").alias("dj"))
    df = a.df.join(left, "i").join(right, "j").select("i", "j", (F.col("di") * F.col("v") * F.col("dj")).alias("v"))
    return a.with_entries(df)


def dense_to_sparse_transposed(b: DenseMatrix) -> SparseMatrix:
    """All cells of Bᵀ as stored entries."""
    return SparseMatrix(b.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), b.ncols, b.nrows)


def threshold_columns(cells: DataFrame, group: list[str], tol: float = 1e-3) -> DataFrame:
    """Scale each group of ``v`` to max magnitude 1 and keep ``abs(v) > tol``."""
    peak = cells.groupBy(*group).agg(F.max(F.abs("v")).alias("_peak")).where("_peak > 0")
    scaled = cells.join(peak, group).withColumn("v", F.col("v") / F.col("_peak")).drop("_peak")
    return scaled.where(F.abs("v") > tol)

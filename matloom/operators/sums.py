"""Unions of patterns, with and without values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.model import SparseMatrix


def add(a: SparseMatrix, b: SparseMatrix, c: float = 1.0) -> SparseMatrix:
    """c·A + B; entries that cancel stay stored as zeros."""
    if (a.nrows, a.ncols) != (b.nrows, b.ncols):
        raise ValueError("shapes differ")
    same = a.structure == b.structure
    left, right = (a.df, b.df) if same else (a.entries(), b.entries())
    scaled = left.select("i", "j", (F.lit(c) * F.col("v")).alias("v"))
    df = scaled.unionByName(right).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return SparseMatrix(df, a.nrows, a.ncols, a.structure if same else "general")


def union_pattern(a: SparseMatrix, keep_diagonal: bool = True) -> DataFrame:
    """Pattern ``(i, j)`` of A + Aᵀ."""
    half = a.df.select("i", "j")
    both = half.union(a.df.select("j", "i"))
    if not keep_diagonal:
        both = both.where("i <> j")
    return both.distinct()


def union_pattern_counts(a: SparseMatrix, keep_diagonal: bool = True) -> DataFrame:
    """``(i, n)``: row sizes of A + Aᵀ, zero rows included."""
    counts = union_pattern(a, keep_diagonal).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    rows = a.spark.range(a.nrows).select(F.col("id").alias("i"))
    return rows.join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))


def merge_levels(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Union of leveled patterns, lowest level on a tie."""
    return left.unionByName(right).groupBy(*keys).agg(F.min("level").alias("level"))

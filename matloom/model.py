"""Matrices, vectors, graphs and permutations as plain DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRUCTURES = ("general", "sym_upper", "lower", "upper")


def _require(df: DataFrame, names: tuple[str, ...]) -> None:
    if tuple(df.columns) != names:
        raise ValueError(f"expected columns {names}, got {tuple(df.columns)}")


def index(spark: SparkSession, n: int) -> DataFrame:
    """All row numbers of an n-row object."""
    return spark.range(n).select(F.col("id").alias("i"))


@dataclass(frozen=True)
class SparseMatrix:
    """Entries ``(i, j, v)``, zero based, unique per ``(i, j)``.

    ``sym_upper`` keeps the upper triangle of a symmetric matrix only.
    Stored zeros are entries and stay until pruned.
    """

    df: DataFrame
    nrows: int
    ncols: int
    structure: str = "general"
    positive_definite: bool = False

    def __post_init__(self):
        _require(self.df, ("i", "j", "v"))
        if self.structure not in STRUCTURES:
            raise ValueError(f"unknown structure {self.structure!r}")

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_entries(self, df: DataFrame, **changes) -> SparseMatrix:
        return replace(self, df=df, **changes)

    def entries(self) -> DataFrame:
        """Entries of the full matrix, mirrored when only half is stored."""
        if self.structure != "sym_upper":
            return self.df
        mirrored = self.df.where("i <> j").select(
            F.col("j").alias("i"), F.col("i").alias("j"), "v"
        )
        return self.df.unionByName(mirrored)

    def edges(self) -> DataFrame:
        """The stored pattern as directed arcs."""
        return self.entries().select(F.col("i").alias("src"), F.col("j").alias("dst"))


@dataclass(frozen=True)
class Vector:
    """``(i, v)`` with one row for every index below ``n``."""

    df: DataFrame
    n: int

    def __post_init__(self):
        _require(self.df, ("i", "v"))


@dataclass(frozen=True)
class DenseMatrix:
    """Every cell of a dense matrix as ``(i, j, v)``."""

    df: DataFrame
    nrows: int
    ncols: int

    def __post_init__(self):
        _require(self.df, ("i", "j", "v"))


@dataclass(frozen=True)
class Permutation:
    """A bijection: position ``new_id`` holds what was at ``old_id``."""

    df: DataFrame
    n: int

    def __post_init__(self):
        _require(self.df, ("new_id", "old_id"))

    def inverse(self) -> Permutation:
        return Permutation(
            self.df.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("old_id")), self.n
        )


@dataclass(frozen=True)
class Graph:
    """Directed arcs ``(src, dst)`` and the vertex table ``(id)``."""

    edges: DataFrame
    vertices: DataFrame

    def __post_init__(self):
        _require(self.edges, ("src", "dst"))
        _require(self.vertices, ("id",))

    @classmethod
    def of(cls, a: SparseMatrix) -> Graph:
        n = max(a.nrows, a.ncols)
        return cls(a.edges(), a.spark.range(n))

    def undirected(self) -> DataFrame:
        """Both directions of every arc, once, without self loops."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return self.edges.union(back).where("src <> dst").distinct()

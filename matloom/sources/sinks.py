"""Writers and inspection output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.model import SparseMatrix, Vector
from matloom.operators.structure import row_pointer
from matloom.runtime import Workspace


def gnuplot_lines(a: SparseMatrix) -> DataFrame:
    """One line ``col -row`` per stored entry."""
    return a.df.select(F.concat_ws(" ", F.col("j").cast("string"), (-F.col("i")).cast("string")).alias("line"))


def svg_rects(a: SparseMatrix) -> DataFrame:
    """One unit square per stored entry."""
    return a.df.select(
        F.format_string('<rect x="%d" y="%d" width="1" height="1"/>', "j", "i").alias("line")
    )


def write_gnuplot(a: SparseMatrix, path: str) -> None:
    gnuplot_lines(a).write.text(path)


def write_svg(a: SparseMatrix, path: str) -> None:
    """A folder of text parts; their concatenation in name order is one SVG."""
    spark = a.spark
    opening = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {a.ncols} {a.nrows}">'
    first = spark.range(1).select(F.lit(opening).alias("line"))
    last = spark.range(1).select(F.lit("</svg>").alias("line"))
    # A union keeps its sides' partitions in order; entries stay in their own parts.
    first.union(svg_rects(a)).union(last).write.text(path)


def write_matrix(a: SparseMatrix, path: str) -> None:
    """Entries as parquet, sizes in a one-row table beside them."""
    a.df.write.parquet(f"{path}/entries")
    meta = a.spark.range(1).select(
        F.lit(a.nrows).cast("bigint").alias("nrows"),
        F.lit(a.ncols).cast("bigint").alias("ncols"),
        F.lit(a.structure).alias("structure"),
        F.lit(a.positive_definite).alias("positive_definite"),
    )
    meta.write.parquet(f"{path}/shape")


def read_matrix(spark, path: str) -> SparseMatrix:
    m = spark.read.parquet(f"{path}/shape").first()
    df = spark.read.parquet(f"{path}/entries").select("i", "j", "v")
    return SparseMatrix(df, m["nrows"], m["ncols"], m["structure"], m["positive_definite"])


def write_vector(x: Vector, path: str) -> None:
    x.df.write.parquet(path)


def compressed_rows(ws: Workspace, a: SparseMatrix, base: int = 0) -> tuple[DataFrame, DataFrame]:
    """Row pointers ``(i, ptr)`` and row-major entries ``(i, j, v)`` from ``base``."""
    ptr = row_pointer(ws, a, base)
    body = a.df.select("i", (F.col("j") + base).alias("j"), "v").orderBy("i", "j")
    return ptr, body


def matrix_market_lines(a: SparseMatrix, nnz: int) -> DataFrame:
    """Banner, size line and 1-based entries, in that order."""
    spark = a.spark
    kind = "symmetric" if a.structure == "sym_upper" else "general"
    head = f"%%MatrixMarket matrix coordinate real {kind}"
    rows = spark.createDataFrame([(0, head), (1, f"{a.nrows} {a.ncols} {nnz}")], "o int, line string").coalesce(1)
    # The format stores the lower half of a symmetric matrix.
    i, j = ("j", "i") if a.structure == "sym_upper" else ("i", "j")
    body = a.df.select(
        F.lit(2).alias("o"),
        F.concat_ws(" ", (F.col(i) + 1).cast("string"), (F.col(j) + 1).cast("string"), F.col("v").cast("string")),
    )
    return rows.union(body)


def write_matrix_market(a: SparseMatrix, path: str) -> None:
    """Text parts whose concatenation in name order is one file.  The head is the
    first part; entries stay in the parts of their input."""
    stored = Workspace(a.spark).save(a.df, rows=F.count(F.lit(1)))
    lines = matrix_market_lines(a.with_entries(stored.df), stored.rows)
    # A union keeps its sides' partitions in order, the head before all entries.
    lines.select("line").write.text(path)

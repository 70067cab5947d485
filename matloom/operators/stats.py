"""Aggregates over patterns, rows and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matloom.functions.scan import dense_position, running_sum
from matloom.model import SparseMatrix, Vector, index
from matloom.runtime import Workspace

_TINY = 2.2250738585072014e-308  # smallest normal double


def degree(a: SparseMatrix) -> DataFrame:
    """``(id, deg)``: stored entries per row, self loops counted."""
    counts = a.entries().groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    return a.spark.range(a.nrows).join(counts, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))


def min_degree(degrees: DataFrame) -> DataFrame:
    """One row ``(id, deg)``: lowest degree, lowest id on a tie."""
    best = degrees.agg(F.min(F.struct("deg", "id")).alias("m"))
    return best.select(F.col("m.id").alias("id"), F.col("m.deg").alias("deg"))


def sliding_min_degree(degrees: DataFrame, width: int = 10) -> DataFrame:
    """Arg-min degree of the ``width`` ids ending at each id.

    Each row is offered to the windows it belongs to, so the job is a grouped
    minimum and needs no global window.
    """
    ends = F.explode(F.sequence(F.col("id"), F.col("id") + width - 1)).alias("end")
    offered = degrees.select("id", "deg", ends)
    best = offered.groupBy("end").agg(F.min(F.struct("deg", "id")).alias("m"))
    return degrees.select(F.col("id").alias("end")).join(best, "end").select(
        F.col("end").alias("id"), F.col("m.id").alias("min_id"), F.col("m.deg").alias("min_deg")
    )


def shape(a: SparseMatrix) -> DataFrame:
    """Rows, columns, stored entries, entries per row (integer division)."""
    return a.df.agg(F.count(F.lit(1)).alias("nnz")).select(
        F.lit(a.nrows).cast("bigint").alias("nrows"),
        F.lit(a.ncols).cast("bigint").alias("ncols"),
        "nnz",
        F.expr(f"nnz div {max(a.nrows, 1)}").alias("avg_nnz"),
    )


def max_nnz(a: SparseMatrix) -> DataFrame:
    return a.df.groupBy("i").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_nnz"))


def row_spread(a: SparseMatrix) -> DataFrame:
    """Largest distance between the first and last column of a row."""
    return a.df.groupBy("i").agg((F.max("j") - F.min("j")).alias("s")).agg(F.max("s").alias("row_spread"))


def bandwidth(a: SparseMatrix) -> DataFrame:
    """Largest distance of an entry from the diagonal."""
    return a.df.agg(F.max(F.abs(F.col("i") - F.col("j"))).alias("bandwidth"))


def row_scaling(a: SparseMatrix) -> Vector:
    """‖row‖₂^(−1/2) of the full matrix; rows without weight give 1."""
    sums = a.entries().groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    value = F.when(F.col("s") > _TINY, 1.0 / F.sqrt(F.sqrt("s"))).otherwise(1.0)
    return Vector(index(a.spark, a.nrows).join(sums, "i", "left").select("i", value.alias("v")), a.nrows)


def _per_cell_checks(a: SparseMatrix, wrong_side: str) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    outside = (i < 0) | (i >= a.nrows) | (j < 0) | (j >= a.ncols)

    def total(column):
        return F.coalesce(F.sum(column), F.lit(0))

    per_cell = a.df.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return per_cell.agg(
        total(F.when(outside, F.col("n")).otherwise(0)).alias("out_of_range"),
        total(F.col("n") - 1).alias("duplicates"),
        total(F.when(F.expr(wrong_side), F.col("n")).otherwise(0)).alias("wrong_side"),
    )


def validity(a: SparseMatrix) -> DataFrame:
    """One row: out-of-range entries, surplus duplicates, and the verdict."""
    found = _per_cell_checks(a, "false").drop("wrong_side")
    return found.withColumn("valid", (F.col("out_of_range") == 0) & (F.col("duplicates") == 0))


def structure_check(a: SparseMatrix) -> DataFrame:
    """Validity counts plus entries on the wrong side of a triangular structure."""
    return _per_cell_checks(a, {"lower": "j > i", "upper": "j < i", "sym_upper": "j < i"}.get(a.structure, "false"))


def symmetry(a: SparseMatrix) -> DataFrame:
    """One row: cells whose mirror is absent, cells whose mirror differs."""
    here = a.entries().select("i", "j", F.lit(1).alias("n"), "v")
    there = a.entries().select("j", "i", F.lit(-1), -F.col("v"))
    # A cell and its mirror cancel in both sums exactly when they agree.
    cells = here.union(there).groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")
    )
    return cells.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)), F.lit(0)).alias("pattern_misses"),
        F.coalesce(
            F.sum(F.when((F.col("n") == 0) & (F.col("v") > 0), 1).otherwise(0)), F.lit(0)
        ).alias("value_misses"),
    ).withColumn("symmetric", (F.col("pattern_misses") == 0) & (F.col("value_misses") == 0))


def vector_norm(x: Vector) -> DataFrame:
    return x.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def vector_dot(x: Vector, y: Vector) -> DataFrame:
    return x.df.join(y.df.withColumnRenamed("v", "w"), "i").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))


def axpy(alpha: float, x: Vector, y: Vector) -> Vector:
    """α·x + y."""
    df = x.df.join(y.df.withColumnRenamed("v", "w"), "i")
    return Vector(df.select("i", (F.lit(alpha) * F.col("v") + F.col("w")).alias("v")), x.n)


def scale_vector(alpha: float, x: Vector) -> Vector:
    return Vector(x.df.select("i", (F.lit(alpha) * F.col("v")).alias("v")), x.n)


def max_abs(x: Vector) -> DataFrame:
    return x.df.agg(F.max(F.abs("v")).alias("max_abs"))


def min_diagonal(a: SparseMatrix) -> DataFrame:
    return a.df.where("i = j").agg(F.min("v").alias("min_diag"))


def top_entries(a: SparseMatrix, k: int) -> SparseMatrix:
    """The k largest magnitudes of each row, lower column on a tie.

    The rank filter becomes a group limit that also runs before the shuffle, so
    a heavy row sends at most k entries per task.
    """
    w = Window.partitionBy("i").orderBy(F.abs("v").desc(), F.col("j"))
    kept = a.df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return a.with_entries(kept)


def row_segments(a: SparseMatrix) -> DataFrame:
    """``(i, s, n)``: sum and size of every stored row segment."""
    return a.df.groupBy("i").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))


def sorted_entries(ws: Workspace, a: SparseMatrix) -> DataFrame:
    """Entries with their position in row-major order."""
    return dense_position(ws, a.df, [F.col("i"), F.col("j")], "pos").select("pos", "i", "j", "v")


def even_partition(n: int, parts: int, spark) -> DataFrame:
    """``(part, first, past)``: split 0..n into nearly equal ranges, long ones first."""
    size, extra = divmod(n, parts)
    p = F.col("id")
    first = p * size + F.least(p, F.lit(extra))
    past = first + size + F.when(p < extra, 1).otherwise(0)
    return spark.range(parts).select(p.alias("part"), first.alias("first"), past.alias("past"))


def weighted_partition(ws: Workspace, weights: DataFrame, parts: int) -> DataFrame:
    """``(part, first, past)``: contiguous ids cut where the running weight
    reaches each part's target share; ``weights`` is ``(id, w)`` for 0..n-1."""
    scanned = ws.save(running_sum(ws, weights, [F.col("id")], "w", "upto"), total=F.sum("w"))
    total, n = int(scanned.stats["total"] or 0), scanned.rows
    size, extra = divmod(total, parts)

    def opened(weight):
        """How many parts after the first have a target of at most ``weight``."""
        if size == 0:
            many = F.when(weight >= extra, F.lit(parts - 1)).otherwise(weight)
        else:
            many = F.when(
                weight >= extra * (size + 1), F.floor((weight - extra) / size)
            ).otherwise(F.floor(weight / (size + 1)))
        return F.least(many, F.lit(parts - 1)).cast("bigint")

    upto = F.col("upto")
    spans = scanned.df.select(
        (F.col("id") + 1).alias("first"), (opened(upto - F.col("w")) + 1).alias("lo"), opened(upto).alias("hi")
    )
    cuts = spans.where("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("part"), "first")
    spark = weights.sparkSession
    part = F.col("id").alias("part")
    # Part 0 starts at 0; parts whose target lies beyond every id are empty.
    first = F.when(F.col("part") == 0, 0).otherwise(F.coalesce("first", F.lit(n))).cast("bigint")
    starts = spark.range(parts).select(part).join(cuts, "part", "left").select("part", first.alias("first"))
    nxt = starts.select((F.col("part") - 1).alias("part"), F.col("first").alias("past"))
    return starts.join(nxt, "part", "left").select("part", "first", F.coalesce("past", F.lit(n)).alias("past"))

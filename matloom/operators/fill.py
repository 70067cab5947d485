"""Fill patterns of incomplete and complete factorisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.operators.graph import elimination_tree
from matloom.runtime import RoundLog, Workspace


def _grow(ws: Workspace, start: DataFrame, k: int, meet) -> DataFrame:
    """Add fill level by level.  A cell of level r comes from two cells whose
    levels sum to r − 1, so round r joins only those and keeps what is new."""
    known = ws.save(start.select("i", "j").distinct().withColumn("level", F.lit(0))).df
    for r in range(1, k + 1):
        pairs = meet(known).where(F.col("la") + F.col("lb") == r - 1)
        new = pairs.select("i", "j").distinct().join(known, ["i", "j"], "left_anti")
        known = known.unionByName(ws.save(new.withColumn("level", F.lit(r))).df)
    return known


def ic_pattern(ws: Workspace, upper: DataFrame, k: int) -> DataFrame:
    """``(i, j, level)`` of IC(k) on the upper cells ``(i, j)``.

    Cells (q, a) and (q, b) of one pivot row, a < b, give (a, b) at the sum of
    their levels plus one; the lowest level wins and levels above k are dropped.
    """

    def meet(cells: DataFrame) -> DataFrame:
        strict = cells.where("i < j")
        a = strict.select(F.col("i").alias("q"), F.col("j").alias("a"), F.col("level").alias("la"))
        b = strict.select(F.col("i").alias("q"), F.col("j").alias("b"), F.col("level").alias("lb"))
        return a.join(b, "q").where("a < b").select(F.col("a").alias("i"), F.col("b").alias("j"), "la", "lb")

    return _grow(ws, upper.where("i <= j"), k, meet)


def ilu_pattern(ws: Workspace, cells: DataFrame, k: int) -> DataFrame:
    """``(i, j, level)`` of ILU(k): (i, q) below and (q, j) right of pivot q."""

    def meet(known: DataFrame) -> DataFrame:
        a = known.where("i > j").select("i", F.col("j").alias("q"), F.col("level").alias("la"))
        b = known.where("i < j").select(F.col("i").alias("q"), "j", F.col("level").alias("lb"))
        return a.join(b, "q").select("i", "j", "la", "lb")

    return _grow(ws, cells, k, meet)


def complete_pattern(ws: Workspace, upper: DataFrame, vertices: DataFrame) -> DataFrame:
    """Upper cells ``(i, j)`` of the complete Cholesky factor.

    A cell (i, j) also fills (a, j) for every ancestor a of i below j, so cells
    climb the elimination tree one step per round and no pairs are formed.
    """
    tree = elimination_tree(ws, upper, vertices).where("parent >= 0")
    tree = ws.save(tree.select(F.col("id").alias("i"), "parent"))
    log = RoundLog(ws, "i long, j long")
    fresh = log.append(upper.where("i <= j").select("i", "j").distinct())
    while fresh.rows:
        climbed = fresh.df.join(tree.df, "i").where("parent <= j")
        climbed = climbed.select(F.col("parent").alias("i"), "j").distinct()
        fresh = log.append(climbed.join(log.all(), ["i", "j"], "left_anti"))
    return log.all().select("i", "j")

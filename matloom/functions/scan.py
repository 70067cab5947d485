"""Global ranks and running sums without a single-task window.

A sort range-partitions the rows; each partition is scanned on its own and then
shifted by the total of the partitions before it.  Only one row per partition
meets in the offset step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matloom.runtime import Workspace

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in these low bits


def _sorted_parts(ws: Workspace, df: DataFrame, order: list[Column]) -> DataFrame:
    tagged = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    # Kept once: range bounds are sampled, so a recomputation could cut elsewhere.
    return ws.save(tagged).df.withColumn("_part", F.shiftright("_m", _ROW_BITS))


def _offsets(parts: DataFrame, total: Column) -> DataFrame:
    """Exclusive running total over partitions; one row per sort partition."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.groupBy("_part")
        .agg(total.alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_before"))
    )


def dense_position(ws: Workspace, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the zero-based global position under ``order`` (a total order)."""
    parts = _sorted_parts(ws, df, order)
    offsets = _offsets(parts, F.count(F.lit(1)))
    local = F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local)
        .drop("_m", "_part", "_before")
    )


def running_sum(ws: Workspace, df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add the inclusive running sum of ``value`` under ``order``."""
    parts = _sorted_parts(ws, df, order)
    offsets = _offsets(parts, F.sum(value))
    within = Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.withColumn("_within", F.sum(value).over(within))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_m", "_part", "_before", "_within")
    )


def order_key(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add an increasing, not gap-free, 64-bit key under ``order``."""
    return df.orderBy(*order).withColumn(name, F.monotonically_increasing_id())


def rank_within(ws: Workspace, df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add the zero-based rank inside each group; heavy groups span many tasks."""
    placed = dense_position(ws, df, [*[F.col(g) for g in group], *order], "_pos")
    starts = placed.groupBy(*group).agg(F.min("_pos").alias("_start"))
    return placed.join(starts, group).withColumn(name, F.col("_pos") - F.col("_start")).drop("_pos", "_start")

"""Seeded generators; results do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.functions.scan import dense_position
from matloom.model import Permutation, SparseMatrix, Vector
from matloom.runtime import Workspace


def scaled_identity(spark: SparkSession, n: int, value: float = 1.0) -> SparseMatrix:
    df = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(value)).alias("v"))
    return SparseMatrix(df, n, n)


def random_pattern(rows: DataFrame, ncols: int, per_row: int, seed: int, nrows: int | None = None) -> SparseMatrix:
    """Exactly ``per_row`` distinct columns for each ``(i)`` of ``rows``, values 0.

    The matrix is square unless ``nrows`` is given."""

    def draw(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            ids = batch["i"].to_numpy()
            picks = [
                np.sort(np.random.default_rng((seed, int(i))).choice(ncols, per_row, replace=False, shuffle=False))
                for i in ids
            ]
            cols = np.concatenate(picks) if picks else np.empty(0, "i8")
            yield pd.DataFrame({"i": np.repeat(ids, per_row), "j": cols, "v": np.zeros(len(cols))})

    if per_row > ncols:
        raise ValueError("more entries per row than columns")
    df = rows.select("i").mapInPandas(draw, "i long, j long, v double")
    return SparseMatrix(df, ncols if nrows is None else nrows, ncols)


def _unit(seed: int, *columns: str):
    """A hash-based number in [0, 1) that depends on the key only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def random_values(a: SparseMatrix, seed: int) -> SparseMatrix:
    """Replace the values by uniform numbers in [0, 1)."""
    return a.with_entries(a.df.select("i", "j", _unit(seed, "i", "j").alias("v")))


def random_vector(rows: DataFrame, n: int, seed: int, low: float = 0.0, high: float = 1.0) -> Vector:
    """Uniform numbers in [low, high) for each ``(i)`` of ``rows``."""
    return Vector(rows.select("i", (F.lit(low) + F.lit(high - low) * _unit(seed, "i")).alias("v")), n)


def sample_ordered(ids: DataFrame, m: int, seed: int) -> DataFrame:
    """``m`` distinct ids of ``(id)`` without replacement; the top-m of a keyed
    hash order, which Spark takes per partition first."""
    return ids.withColumn("_u", _unit(seed, "id")).orderBy("_u", "id").limit(m).select("id")


def random_permutation(ws: Workspace, ids: DataFrame, n: int, seed: int) -> Permutation:
    keyed = ids.withColumn("_u", _unit(seed, "id"))
    placed = dense_position(ws, keyed, [F.col("_u"), F.col("id")], "new_id")
    return Permutation(placed.select("new_id", F.col("id").alias("old_id")), n)

"""Matrix-Market coordinate text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matloom.model import SparseMatrix

# Fixed values of the format.
FIELDS = ("real", "integer", "pattern", "double")
SYMMETRIES = ("general", "symmetric", "skew-symmetric")


def read_matrix_market(
    spark: SparkSession, path: str, base: int | str = 1, duplicates: str = "sum"
) -> SparseMatrix:
    """Read a file, or a folder of parts, as zero-based entries; lines are parsed
    where they lie.

    ``base`` is 1 by the format, 0 for files counted from zero, or "auto": one
    based exactly when the largest index equals the dimension.  ``duplicates``:
    "sum", "keep" or "error".
    """
    lines = spark.read.text(path).select(
        F.btrim("value", F.lit(" \t\r")).alias("line"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_path").alias("file"),
    )
    # The banner and the size line sit at the head of one file's first block.
    banner = lines.where("start = 0 AND line LIKE '%%MatrixMarket%'").select("line", "file").first()
    if banner is None:
        raise ValueError(f"{path}: no MatrixMarket banner")
    _, kind, layout, field, symmetry = banner["line"].lower().split()[:5]
    if (kind, layout) != ("matrix", "coordinate") or field not in FIELDS or symmetry not in SYMMETRIES:
        raise ValueError(f"{path}: unsupported header {banner['line']!r}")

    head = lines.where((F.col("start") == 0) & (F.col("file") == banner["file"]))
    data = "line <> '' AND NOT startswith(line, '%')"
    size_line = head.where(data).select("line").first()["line"]
    nrows, ncols, _ = (int(t) for t in size_line.split())
    body = lines.where(data).select("line")
    # An entry may read exactly like the size line: leave out one such line only.
    twins = body.where(F.col("line") == size_line).count() - 1
    entries = body.where(F.col("line") != size_line)
    if twins:
        entries = entries.union(spark.range(twins).select(F.lit(size_line)))

    tok = F.split("line", r"\s+")
    value = F.lit(1.0) if field == "pattern" else tok[2].cast("double")
    df = entries.select(tok[0].cast("bigint").alias("i"), tok[1].cast("bigint").alias("j"), value.alias("v"))
    if base == "auto":
        top = df.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
        base = 1 if top["i"] == nrows or top["j"] == ncols else 0
    df = df.select((F.col("i") - base).alias("i"), (F.col("j") - base).alias("j"), "v")
    df = _resolve(df, duplicates)
    if symmetry != "general":
        sign = -1.0 if symmetry == "skew-symmetric" else 1.0
        mirrored = df.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.lit(sign) * F.col("v")).alias("v"))
        df = df.unionByName(mirrored)
    return SparseMatrix(df, nrows, ncols)


def _resolve(df, duplicates: str):
    if duplicates == "keep":
        return df
    cells = df.groupBy("i", "j").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    if duplicates == "error":
        clash = F.raise_error(F.format_string("duplicate entry (%d, %d)", "i", "j"))
        cells = cells.withColumn("v", F.when(F.col("n") > 1, clash).otherwise(F.col("v")))
    elif duplicates != "sum":
        raise ValueError(f"unknown duplicates mode {duplicates!r}")
    return cells.select("i", "j", "v")

"""Packed binary triplets and vectors, read in byte ranges.

The driver asks the file system for the length only.  Each task opens the file
on its own, seeks to its range and decodes it with numpy, so one large file is
spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.model import SparseMatrix, Vector

HEADER_BYTES = 8
CHUNK_RECORDS = 4_000_000


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _record_count(path: str) -> int:
    import numpy as np

    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        return int(np.frombuffer(f.read_at(HEADER_BYTES, 0), "<i8")[0])


def _ranges(spark: SparkSession, records: int, chunk: int) -> DataFrame:
    chunks = max(1, -(-records // chunk))
    return spark.range(0, chunks, 1, min(chunks, 10_000))


def read_coo(
    spark: SparkSession,
    path: str,
    base: int = 0,
    member_order: tuple[str, str, str] = ("v", "j", "i"),
    chunk: int = CHUNK_RECORDS,
) -> SparseMatrix:
    """``int64 count`` and packed (int32, int32, float64) records.

    The order of the members in a record depends on the writer; the default
    stores the value first.  Sizes come from the largest indices.
    """
    types = {"i": "<i4", "j": "<i4", "v": "<f8"}
    layout = [(name, types[name]) for name in member_order]
    records = _record_count(path)
    opener, header = _open, HEADER_BYTES

    def decode(batches):
        import numpy as np
        import pandas as pd

        dtype = np.dtype(layout)
        system, inner = opener(path)
        with system.open_input_file(inner) as f:
            for batch in batches:
                for c in batch["id"]:
                    first = int(c) * chunk
                    n = min(chunk, records - first)
                    rec = np.frombuffer(f.read_at(n * dtype.itemsize, header + first * dtype.itemsize), dtype)
                    yield pd.DataFrame(
                        {"i": rec["i"].astype("i8") - base, "j": rec["j"].astype("i8") - base, "v": rec["v"]}
                    )

    df = _ranges(spark, records, chunk).mapInPandas(decode, "i long, j long, v double")
    top = df.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    return SparseMatrix(df, (top["i"] if top["i"] is not None else -1) + 1, (top["j"] if top["j"] is not None else -1) + 1)


def read_vector(spark: SparkSession, path: str, chunk: int = CHUNK_RECORDS) -> Vector:
    """``int64 n`` and n float64 values."""
    records = _record_count(path)
    opener, header = _open, HEADER_BYTES

    def decode(batches):
        import numpy as np
        import pandas as pd

        system, inner = opener(path)
        with system.open_input_file(inner) as f:
            for batch in batches:
                for c in batch["id"]:
                    first = int(c) * chunk
                    n = min(chunk, records - first)
                    values = np.frombuffer(f.read_at(n * 8, header + first * 8), "<f8")
                    yield pd.DataFrame({"i": np.arange(first, first + n), "v": values})

    return Vector(_ranges(spark, records, chunk).mapInPandas(decode, "i long, v double"), records)

"""Token ids of documents in ORC files.

Layout: one folder of ORC files, cut by ranges of ``doc_id`` and sorted inside,
so file after file the documents ascend.  ORC stores the id lists as run-length
encoded integers, keeps minimum and maximum of ``doc_id`` per stripe and row
group, and a Bloom filter per row group.  Files are read stripe by stripe in
parallel, and a search for document ids opens only row groups that may hold them.

A row has the number of ids before it *in its file*; the ids in earlier files
are added from a manifest of one row per file, so that no running total has to
pass from task to task while the files are written.

Defined results: a null text is an empty document (its end id alone); a null
doc_id sorts first; rows of one doc_id keep no particular order among
themselves; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matloom.llm.common import bound_batches, documents, in_blocks
from matloom.llm.registry import query
from matloom.llm.tokens import END_ID, tokenizer
from matloom.runtime import Workspace

ROW = "doc_id long, file int, before long, n_tokens int, ids array<int>"
#: Rows per index entry and Bloom filter; bytes of a stripe before compression.
INDEX_ROWS = 1000
STRIPE_BYTES = 16 << 20
BLOOM_FPP = 0.01


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encode ``(doc_id, text)`` and write the folder ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, before = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in in_blocks(batches):
            coded = [coder.encode(t.as_py()) + end for t in batch.column("text").cast(pa.large_binary())]
            ends = np.cumsum([0] + [len(c) // 4 for c in coded])
            ids = pa.array(np.frombuffer(b"".join(coded), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(coded), file, "i4")),
                    pa.array(before + ends[:-1]),
                    pa.array(np.diff(ends).astype("i4")),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids),
                ],
                ["doc_id", "file", "before", "n_tokens", "ids"],
            )
            before += int(ends[-1])

    bound_batches(docs)
    ascending = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        ascending.mapInArrow(encode, ROW)
        .write.mode("errorifexists")
        .option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(path)
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, first)``: ids in all files before; one row per file."""
    sizes = spark.read.schema(ROW).orc(path).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``; ``doc_ids`` prunes by file metadata."""
    rows = spark.read.schema(ROW).orc(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    # One row per file, so the broadcast side is bounded by the file count.
    placed = rows.join(F.broadcast(manifest(spark, path)), "file")
    return placed.select("doc_id", (F.col("first") + F.col("before")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def checksums(store: DataFrame) -> DataFrame:
    """Replace the ids by the checksum of their little-endian 32-bit form."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return store.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op6_token_orc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, file_factor=1).new_path("tokens")
    write_store(documents(spark, sf_dir), path)
    return checksums(read_store(spark, path))

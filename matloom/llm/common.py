"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of the word rule ``[^\x20\x09-\x0D]+``.
SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    Catalyst may paste an aliased expression into a lambda that runs per
    element; a lambda variable is bound to the finished value.
    """
    return F.transform(F.array(value), body)[0]


#: Bytes of an Arrow batch; texts are long, and a batch exists several times on its way.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> None:
    """Keep the Arrow batches of a session small where it leaves the default."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_SETTING).rstrip("b")) >= 64 << 20:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are unpacked at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        # Workers live on between tasks; Arrow would keep what it has freed.
        pa.default_memory_pool().release_unused()


def in_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``size`` bytes of text; one longer text stays whole."""
    for batch in batches:
        total, begin = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if total and total + n > size:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
        pa.default_memory_pool().release_unused()

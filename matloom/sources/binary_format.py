"""Packed binary matrices and vectors as Spark data sources.

``binary_coo``: records (int32, int32, float64) whose order of members is an
option; ``binary_vector``: float64 values whose index is their place.  A path is
one file that begins with the number of its records, or a folder of parts without
such a header.  Readers plan ranges of records from file sizes alone and each task
seeks to its own; ranges of a small ``chunk`` are dealt to tasks many at a time.  Writers leave one part per task; a part appears under its name
only when the whole job commits, so lost or repeated tasks leave nothing behind.

    spark.dataSource.register(BinaryCoo)
    df.write.format("binary_coo").mode("append").option("base", 1).save(path)
    spark.read.format("binary_coo").option("base", 1).load(path)

Indices outside 32 bits are an error of the writing task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from matloom.model import SparseMatrix, Vector

HEADER_BYTES = 8
#: Records of one input partition, and of one batch.
CHUNK_RECORDS, BATCH_RECORDS = 4_000_000, 262_144
#: Input partitions beyond which one takes several ranges, while they hold less than CHUNK_RECORDS.
PARTITIONS = 64
_MEMBERS = {"i": "<i4", "j": "<i4", "v": "<f8"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Range(InputPartition):
    """``count`` records of a file from byte ``at``; the first has index ``first``."""

    path: str
    at: int
    count: int
    first: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads one after the other."""

    ranges: list[Range]


@dataclass
class Part(WriterCommitMessage):
    temporary: str
    first: int
    count: int


def _record(options: dict) -> np.dtype:
    members = [m.strip() for m in options.get("order", "v,j,i").split(",")]
    if sorted(members) != ["i", "j", "v"]:
        raise ValueError(f"order must name i, j and v once, got {members}")
    return np.dtype([(m, _MEMBERS[m]) for m in members])


class _Reader(DataSourceReader):
    def __init__(self, options: dict, dtype: np.dtype):
        self.path, self.dtype = options["path"], dtype
        self.base, self.chunk = int(options.get("base", 0)), int(options.get("chunk", CHUNK_RECORDS))

    def partitions(self) -> list[Ranges]:
        system, inner = located(self.path)
        size = self.dtype.itemsize
        if system.get_file_info(inner).type == fs.FileType.File:
            with system.open_input_file(inner) as f:
                records = int(np.frombuffer(f.read_at(HEADER_BYTES, 0), "<i8")[0])
            files = [(inner, HEADER_BYTES, records, 0)]
        else:
            found = [x for x in system.get_file_info(fs.FileSelector(inner)) if x.base_name.startswith("part-")]
            files = [(x.path, 0, x.size // size, int(x.base_name.split("-")[1])) for x in found]
        ranges = [
            Range(path, head + at * size, min(self.chunk, n - at), first + at)
            for path, head, n, first in files
            for at in range(0, n, self.chunk)
        ]
        # A task per range would cost more than its few records.
        total = sum(x.count for x in ranges)
        most = min(CHUNK_RECORDS, -(-total // PARTITIONS))
        out, held = [], 0
        for x in ranges:
            if not out or held + x.count > max(most, 1):
                out.append(Ranges([]))
                held = 0
            out[-1].ranges.append(x)
            held += x.count
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges:
            yield from self.read_range(part)

    def read_range(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        with system.open_input_file(partition.path) as f:
            for at in range(0, partition.count, BATCH_RECORDS):
                n = min(BATCH_RECORDS, partition.count - at)
                rec = np.frombuffer(f.read_at(n * self.dtype.itemsize, partition.at + at * self.dtype.itemsize), self.dtype)
                yield self.batch(rec, partition.first + at)

    def batch(self, rec: np.ndarray, first: int) -> pa.RecordBatch:
        columns = [rec["i"].astype("i8") - self.base, rec["j"].astype("i8") - self.base, np.ascontiguousarray(rec["v"])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "v"])


class _VectorReader(_Reader):
    def batch(self, rec: np.ndarray, first: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rec))), pa.array(rec)], ["i", "v"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, dtype: np.dtype, overwrite: bool):
        self.path, self.dtype, self.overwrite = options["path"], dtype, overwrite
        self.base, self.run = int(options.get("base", 0)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, inner = located(self.path)
        system.create_dir(inner, recursive=True)
        name, first, count = f"{inner}/_{self.run}-{uuid.uuid4().hex}", 0, 0
        with system.open_output_stream(name) as out:
            for batch in iterator:
                if batch.num_rows:
                    first = first if count else int(batch.column("i")[0].as_py())
                    self.check(batch, first + count)
                    out.write(self.packed(batch).tobytes())
                    count += batch.num_rows
        return Part(name, first, count)

    def check(self, batch: pa.RecordBatch, expected: int) -> None:
        pass

    def packed(self, batch: pa.RecordBatch) -> np.ndarray:
        rec = np.empty(batch.num_rows, self.dtype)
        for c in "ij":
            index = batch.column(c).to_numpy() + self.base
            if len(index) and not -(2**31) <= index.min() <= index.max() < 2**31:
                raise ValueError(f"column {c} has an index beyond 32 bits")
            rec[c] = index
        rec["v"] = batch.column("v").to_numpy()
        return rec

    def names(self, parts: list[Part]) -> list[tuple[Part, int]]:
        """Parts with the number in their file name."""
        return [(p, k) for k, p in enumerate(parts)]

    def commit(self, messages: list[Part | None]) -> None:
        system, inner = located(self.path)
        parts = [m for m in messages if m is not None]
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(inner)):
                if x.base_name.startswith("part-"):
                    system.delete_file(x.path)
        for part, number in self.names([p for p in parts if p.count]):
            system.move(part.temporary, f"{inner}/part-{number:020d}-{self.run}")
        self._clean(system, inner)

    def abort(self, messages: list[Part | None]) -> None:
        self._clean(*located(self.path))

    def _clean(self, system: fs.FileSystem, inner: str) -> None:
        for x in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if x.base_name.startswith(f"_{self.run}-"):
                system.delete_file(x.path)


class _VectorWriter(_Writer):
    def check(self, batch: pa.RecordBatch, expected: int) -> None:
        index = batch.column("i").to_numpy()
        if index[0] != expected or (np.diff(index) != 1).any():
            raise ValueError("a part of a vector needs consecutive indices")

    def packed(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("v").to_numpy().astype("<f8")

    def names(self, parts: list[Part]) -> list[tuple[Part, int]]:
        return [(p, p.first) for p in parts]


class BinaryCoo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_coo"

    def schema(self) -> str:
        return "i long, j long, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, _record(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, _record(self.options), overwrite)


class BinaryVector(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binary_vector"

    def schema(self) -> str:
        return "i long, v double"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self.options, np.dtype("<f8"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _VectorWriter(self.options, np.dtype("<f8"), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    for source in (BinaryCoo, BinaryVector):
        spark.dataSource.register(source)
    return spark


def write_coo(a: SparseMatrix, path: str, base: int = 0, order: str = "v,j,i") -> None:
    """The entries as a folder of packed parts."""
    registered(a.spark)
    a.entries().select("i", "j", "v").write.format("binary_coo").mode("append").option("base", base).option("order", order).save(path)


def load_coo(spark: SparkSession, path: str, base: int = 0, order: str = "v,j,i", chunk: int = CHUNK_RECORDS) -> DataFrame:
    """``(i, j, v)`` of a file or a folder of parts."""
    return registered(spark).read.format("binary_coo").option("base", base).option("order", order).option("chunk", chunk).load(path)


def write_vector(x: Vector, path: str) -> None:
    """Values by index; each part is named after its first index."""
    registered(x.df.sparkSession)
    ordered = x.df.select("i", "v").repartitionByRange("i").sortWithinPartitions("i")
    ordered.write.format("binary_vector").mode("append").save(path)


def load_vector(spark: SparkSession, path: str, chunk: int = CHUNK_RECORDS) -> DataFrame:
    """``(i, v)`` of a file or a folder of parts."""
    return registered(spark).read.format("binary_vector").option("chunk", chunk).load(path)

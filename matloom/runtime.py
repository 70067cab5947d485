"""Durable intermediate tables for iterative jobs.

Loops cut their lineage by writing parquet tables into the shared folder named
by ``spark.checkpoint.dir``.  Lost executors cost one stage and never the loop,
and Catalyst knows the true size of every table when it picks a join; sizes
carried along by ``checkpoint()`` are products of products after a few rounds.
Matrices that are joined again and again are bucketed once.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 10 * 1024 * 1024  # a counted table below this may be broadcast
#: The same inside a loop, where every round would send its tables through the driver again.
LOOP_BROADCAST_BYTES = 1024 * 1024
CELL_BYTES = 16  # memory of one value in a broadcast row, generously
#: Spark takes the size of a file for that of its table. A loop has hundreds of joins, so
#: what each may send counts as this many times its file: 16 kB of file reach the limit.
LOOP_FILE_FACTOR = 64
BUCKET_ROWS = 128 * 1024  # rows of a loop's state in one bucket
TASK_ROWS = 256 * 1024  # rows of one task's share where a large table is summed by key


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="matloom-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"
_FILE_FACTOR = "spark.sql.sources.fileCompressionFactor"
_ADAPTIVE_THRESHOLD = "spark.sql.adaptive.autoBroadcastJoinThreshold"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


@contextmanager
def modest_broadcasts(spark: SparkSession, file_factor: int = LOOP_FILE_FACTOR) -> Iterator[None]:
    """Plan joins so that a loop does not send its tables through the driver.

    Spark's broadcast threshold is lowered to that of a loop and files count for more
    than their size.  A side that was shuffled already stays where it is.  With a
    factor of 1 only the threshold is lowered, for jobs of few joins.
    """
    before = spark.conf.get(_THRESHOLD)
    size = re.fullmatch(r"\s*(\d+)\s*([bkmgt]?)i?b?\s*", before.lower())
    values = {} if file_factor == 1 else {_FILE_FACTOR: str(float(file_factor)), _ADAPTIVE_THRESHOLD: "-1"}
    if size is not None and int(size[1]) * _UNITS[size[2]] > LOOP_BROADCAST_BYTES:
        values[_THRESHOLD] = str(LOOP_BROADCAST_BYTES)
    with _settings(spark, values):
        yield


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows of a large table in as many parts, by key, as keep a grouped sum small.

    A sum that follows holds a part's keys, not the share of a file or of the
    session's number of partitions, both of which grow with the table.
    """
    return df.repartition(rows // TASK_ROWS, *keys) if rows >= 16 * TASK_ROWS else df


@dataclass(frozen=True)
class Buckets:
    """Keys and number of buckets that the tables of a loop share, so that a round
    joins what it adds with the old state without moving the latter."""

    keys: tuple[str, ...]
    count: int

    @staticmethod
    def of(rows: int, *keys: str) -> Buckets | None:
        """None for tables of one bucket, which stay plain."""
        return Buckets(keys, rows // BUCKET_ROWS) if rows >= 2 * BUCKET_ROWS else None

    def deal(self, df: DataFrame) -> DataFrame:
        """Rows dealt as in the tables; the first table of a loop needs it."""
        return df.repartition(self.count, *self.keys)


@dataclass(frozen=True)
class Saved:
    """A table on shared storage plus totals taken while it was written."""

    df: DataFrame
    path: str
    stats: dict = field(default_factory=dict)
    table: str | None = None

    @property
    def rows(self) -> int:
        if "rows" not in self.stats:
            self.stats["rows"] = self.df.count()
        return self.stats["rows"]

    @property
    def fits(self) -> bool:
        """Counted, and small enough to be sent to every task."""
        return self.rows * len(self.df.columns) * CELL_BYTES <= LOOP_BROADCAST_BYTES


class Workspace:
    """Hands out tables below one private folder of the shared storage."""

    def __init__(self, spark: SparkSession, file_factor: int = LOOP_FILE_FACTOR):
        self.spark, self.file_factor = spark, file_factor
        self.root = f"{shared_folder(spark)}/matloom-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        self._next = 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Drop all bucketed tables and delete the folder.

        Frames read from this workspace cannot be evaluated afterwards: write a
        result that is to stay to a place of its own first.
        """
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()
        folder, fs = self._located(self.root)
        fs.delete(folder, True)

    def new_path(self, label: str = "t") -> str:
        self._next += 1
        return f"{self.root}/{label}-{self._next:05d}"

    def save(
        self,
        df: DataFrame,
        partition_by: str | None = None,
        path: str | None = None,
        even: bool = True,
        buckets: Buckets | None = None,
        **totals: Column,
    ) -> Saved:
        """Write a table; keywords are aggregates observed during the write."""
        path = path or self.new_path()
        schema, stats = df.schema, {}
        if partition_by and even:
            # Even files per value, whatever their share of the rows.
            df = df.hint("rebalance", partition_by)
        if totals:
            totals.setdefault("rows", F.count(F.lit(1)))
            seen = Observation()
            df = df.observe(seen, *[c.alias(k) for k, c in totals.items()])
        writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        if buckets is not None:
            return self._save_bucketed(writer, path, buckets, seen if totals else None)
        with modest_broadcasts(self.spark, self.file_factor):
            writer.parquet(path)
        if totals:
            stats = dict(seen.get)
        return Saved(self.spark.read.schema(schema).parquet(path), path, stats)

    def _save_bucketed(self, writer, path: str, buckets: Buckets, seen: Observation | None) -> Saved:
        table = f"matloom_{uuid.uuid4().hex}"
        self.tables.append(table)
        # Sums arrive in as many partitions as there are buckets, and each task writes its own.
        same = {
            "spark.sql.shuffle.partitions": str(buckets.count),
            "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
        }
        with modest_broadcasts(self.spark, self.file_factor), _settings(self.spark, same):
            writer.bucketBy(buckets.count, *buckets.keys).option("path", path).saveAsTable(table)
        return Saved(self.spark.table(table), path, {} if seen is None else dict(seen.get), table)

    def part(self, path: str, schema: str, key: str, value: int) -> DataFrame:
        """One ``key=value`` folder of a partitioned table, without listing the
        others; empty when nothing was filed there."""
        folder, fs = self._located(f"{path}/{key}={value}")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{path}/{key}={value}")

    def file(self, df: DataFrame, path: str, key: str) -> None:
        """Append rows to the ``key=…`` folders that later rounds read alone."""
        writer = df.hint("rebalance", key).write.mode("append")
        with modest_broadcasts(self.spark, self.file_factor):
            writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(key).parquet(path)

    def discard(self, *gone: Saved | None) -> None:
        """Delete tables that a newer round has replaced."""
        for saved in gone:
            if saved is not None:
                if saved.table:
                    self.spark.sql(f"DROP TABLE IF EXISTS {saved.table}")
                    self.tables.remove(saved.table)
                folder, fs = self._located(saved.path)
                fs.delete(folder, True)

    def _located(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())


class RoundLog:
    """Rows appended round by round as ``round=<n>`` parts of one table."""

    def __init__(self, ws: Workspace, schema: str):
        self.ws, self.schema = ws, schema
        self.path = ws.new_path("log")
        self.rounds = 0
        self.last: Saved | None = None

    def append(self, df: DataFrame, **totals: Column) -> Saved:
        totals.setdefault("rows", F.count(F.lit(1)))
        self.last = self.ws.save(df, path=f"{self.path}/round={self.rounds}", **totals)
        self.rounds += 1
        return self.last

    def recent(self, rounds: int) -> DataFrame:
        """Rows of the last ``rounds`` rounds; no other folder is listed."""
        first = max(0, self.rounds - rounds)
        paths = [f"{self.path}/round={r}" for r in range(first, self.rounds)]
        return self.ws.spark.read.schema(self.schema).parquet(*paths)

    def all(self) -> DataFrame:
        """Every row so far with the ``round`` that added it."""
        return self.ws.spark.read.schema(f"{self.schema}, round int").parquet(self.path)


class Pinned:
    """A table laid out once for repeated equi-joins on ``key``.

    Small tables stay plain parquet, where the other side is broadcast or
    shuffled by size.  Large ones are bucketed on ``(key, salt)``: keys heavier
    than one bucket's share are cut into salted pieces, so a hub key never lands
    in a single task and the big side is never shuffled again.  At most
    ``buckets`` keys can be that heavy, which bounds the hub list.
    """

    BUCKET_ROWS = 4_000_000

    def __init__(self, ws: Workspace, df: DataFrame, key: str, bucket_rows: int | None = None):
        self.ws, self.key, self.hubs, self.table = ws, key, None, None
        plain = ws.save(df, rows=F.count(F.lit(1)))
        self.rows = plain.rows
        # Beyond Spark's limit the buckets grow instead of their number.
        most = int(ws.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        buckets = min(self.rows // (bucket_rows or self.BUCKET_ROWS), most)
        self.df = plain.df
        if buckets < 2:
            return
        share = self.rows // buckets
        hubs = (
            plain.df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > share)
            .select(key, F.ceil(F.col("n") / share).alias("pieces"))
        )
        self.hubs = ws.save(hubs).df
        others = [c for c in plain.df.columns if c != key]
        salted = (
            plain.df.join(F.broadcast(self.hubs), key, "left")
            .withColumn("salt", F.pmod(F.xxhash64(*others), F.coalesce("pieces", F.lit(1))))
            .drop("pieces")
        )
        self.table = f"matloom_{uuid.uuid4().hex}"
        ws.tables.append(self.table)
        (
            salted.repartition(buckets, key, "salt")
            .write.bucketBy(buckets, key, "salt")
            .sortBy(key, "salt")
            .option("path", ws.new_path("bucketed"))
            .saveAsTable(self.table)
        )
        self.df = ws.spark.table(self.table)
        ws.discard(plain)

    def join(self, other: DataFrame, sized_by: Saved | None = None) -> DataFrame:
        """Inner join with ``other``, which carries a column named ``key``.

        ``sized_by`` is a written table with as many rows as ``other``; when it
        is small, a bucketed table is joined by broadcast and stays unsorted.
        """
        if self.table is None:
            return self.df.join(other, self.key)
        if sized_by is not None and sized_by.fits:
            return self.df.join(F.broadcast(other), self.key).drop("salt")
        pieces = F.coalesce("pieces", F.lit(1))
        spread = (
            other.join(F.broadcast(self.hubs), self.key, "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
            .drop("pieces")
        )
        return self.df.join(spread, [self.key, "salt"]).drop("salt")

    def release(self) -> None:
        if self.table:
            self.ws.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

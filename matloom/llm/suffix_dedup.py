"""Removal of repeated byte strings by a distributed, prefix-aware merge sort.

A byte goes when a string of ``WINDOW`` bytes that covers it also starts
elsewhere in the corpus.  Suffixes matter only up to ``WINDOW`` bytes, and
neighbouring ones are sorted together: an item is a run of windows that share an
anchor (see ``anchors``), so equal windows lie in items of one anchor hash.

1. The anchor hashes of all items are counted; items whose anchor occurs once
   cannot repeat and are never sorted.
2. Each task extracts its remaining items, sorts them, and sends the distinct
   ones as front-coded runs to the task that owns the anchor hash.  Items found
   twice in one run are settled there; only one copy goes on, without places.
3. The owner merges its runs with a loser tree that skips known prefixes.  Equal
   neighbours repeat; an item without an equal is compared window by window with
   the others of its anchor.
4. The repeated places go back to their documents, which cut them out.

An anchor that occurs more than ``HOT`` times would give one owner too much.
Its windows are sent singly as 128-bit digests instead, spread over all owners
by digest, so a passage in every third document meets in many tasks.

Defined results: a null text is empty; repeated rows are documents of their own
and repeat each other; texts shorter than a window keep all bytes; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.llm.anchors import BASES, BLOCK, WINDOW, Hashes, runs
from matloom.llm.common import bound_batches, documents, in_blocks
from matloom.llm.merge_sort import merge, pack_run, read_run
from matloom.llm.registry import query
from matloom.runtime import Workspace

#: Items of one anchor beyond which its windows are dealt out by digest.
HOT = 1000
#: Bytes of items that a task collects before it sends its runs.
RUN_BYTES = 32 << 20
#: Items that one owner is meant to merge.
PART_ITEMS = 50_000

ITEMS, DIGESTS, PLACES = 0, 1, 2


# -- items --------------------------------------------------------------------


def find_items(docs: DataFrame) -> DataFrame:
    """``(anchor, d, lo, n)``: the items of ``(d, body)`` rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, text="body", size=BLOCK):
            bodies = [b.as_py() for b in batch.column("body")]
            keys = batch.column("d").to_numpy()
            long = np.array([len(b) > BLOCK for b in bodies])
            groups = [([b for b in bodies if len(b) <= BLOCK], keys[~long], 0)] if not long.all() else []
            for i in np.flatnonzero(long):
                groups += (([bodies[i][at : at + BLOCK + WINDOW - 1]], keys[i : i + 1], at) for at in range(0, len(bodies[i]), BLOCK))
            for texts, keys, shift in groups:
                ends = np.cumsum([len(t) for t in texts])
                lo, n, anchor = runs(np.frombuffer(b"".join(texts), np.uint8), ends)
                owner = np.searchsorted(ends, lo, "right")
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                columns = [pa.array(anchor), pa.array(keys[owner]), pa.array((lo - begins[owner] + shift).astype("i4")), pa.array(n.astype("i4"))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "d", "lo", "n"])

    bound_batches(docs)
    return docs.select("d", "body").mapInArrow(work, "anchor long, d long, lo int, n int")


# -- runs ---------------------------------------------------------------------


class _Run:
    """Items and window digests of some documents, until they are sent."""

    def __init__(self, parts: int, number: int):
        self.parts, self.number, self.bytes = parts, number, 0
        self.items: dict[bytes, list[tuple[int, int]]] = {}
        self.digests: list[tuple[np.ndarray, ...]] = []

    def add(self, d: int, body: bytes, items: list[dict]) -> None:
        hot: dict[int, list[np.ndarray]] = {}
        for x in items:
            lo, n = x["lo"], x["n"]
            if x["hot"]:
                hot.setdefault(lo // BLOCK, []).append(np.arange(lo, lo + n))
                self.bytes += 32 * n
            else:
                key = x["anchor"].to_bytes(8, "big", signed=True) + body[lo : lo + n - 1 + WINDOW]
                self.items.setdefault(key, []).append((d, lo))
                self.bytes += len(key) + 100
        for part, starts in hot.items():
            at = np.concatenate(starts)
            data = np.frombuffer(body, np.uint8, min(len(body) - part * BLOCK, BLOCK + WINDOW - 1), part * BLOCK)
            here = at - part * BLOCK
            two = [Hashes(data, b).of(here, here + WINDOW) for b in BASES]
            self.digests.append((*two, np.full(len(at), d), at.astype(np.int32)))

    def send(self) -> Iterator[tuple[int, int, bytes]]:
        """``(part, kind, blob)`` rows."""
        places: list[tuple[int, int, int]] = []
        parts: dict[int, list] = {}
        for key in sorted(self.items):
            where = self.items[key]
            if len(where) > 1:
                n = len(key) - 8 - WINDOW
                places.extend((d, lo, lo + n) for d, lo in where)
            # The anchor's own bits choose the owner.
            part = int.from_bytes(key[:8], "big") % self.parts
            parts.setdefault(part, []).append((key, len(where) > 1, *where[0]))
        for part, entries in parts.items():
            yield part, ITEMS, pack_run(entries)
        table = [np.array(c, "<i8") for c in zip(*places)] if places else [np.empty(0, "<i8")] * 3
        if self.digests:
            high, low, d, at = (np.concatenate(c) for c in zip(*self.digests))
            order = np.lexsort((at, d, low, high))
            high, low, d, at = (c[order] for c in (high, low, d, at))
            first = np.ones(len(high), bool)
            first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            size = np.diff(np.append(np.flatnonzero(first), len(high)))
            again = np.repeat(size > 1, size)
            table = [np.concatenate(c) for c in zip(table, _ranges(d[again], at[again]))]
            columns = (high[first], low[first], (size > 1).astype("u1"), d[first], at[first].astype("<i4"))
            owner = (columns[0] % np.uint64(self.parts)).astype(np.int64)
            for part in np.unique(owner):
                yield int(part), DIGESTS, _pack(*(c[owner == part] for c in columns))
        if len(table[0]):
            # Settled places travel along; runs are dealt round the owners.
            yield self.number % self.parts, PLACES, _pack(*table)


def _pack(*columns: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return np.array([len(columns[0]), len(body)], "<i8").tobytes() + pa.Codec("zstd").compress(body, asbytes=True)


def _unpack(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    n, size = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    body, at, out = pa.Codec("zstd").decompress(blob[16:], size, asbytes=True), 0, []
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _ranges(d: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Consecutive window starts of a document as (document, first, last)."""
    order = np.lexsort((at, d))
    d, at = d[order].astype("<i8"), at[order].astype("<i8")
    if not len(d):
        return [np.empty(0, "<i8")] * 3
    cut = np.ones(len(d), bool)
    cut[1:] = (d[1:] != d[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(cut)
    return [d[first], at[first], at[np.append(first[1:], len(d)) - 1]]


def send_runs(listed: DataFrame, parts: int) -> DataFrame:
    """``(part, kind, blob)`` from ``(d, body, items)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = _Run(parts, number := TaskContext.get().partitionId())
        for batch in batches:
            for d, body, items in zip(batch.column("d").to_pylist(), batch.column("body"), batch.column("items")):
                run.add(d, body.as_py(), items.as_py())
                if run.bytes > RUN_BYTES:
                    yield from _rows(run.send())
                    run = _Run(parts, number := number + 7919)
        yield from _rows(run.send())

    return listed.select("d", "body", "items", "doc_id").mapInArrow(work, "part int, kind int, blob binary")


def _rows(sent: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for part, kind, blob in sent:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], ["part", "kind", "blob"])


# -- owners -------------------------------------------------------------------


def _settle(group: list[tuple[bytes, bool, list[tuple[int, int]]]]) -> Iterator[tuple[int, int, int]]:
    """Repeated window ranges among the distinct items of one anchor."""
    seen: dict[bytes, int] = {}
    lone = [g for g in group if not g[1]]
    for key, many, where in group:
        if many:
            yield from ((d, lo, lo + len(key) - 8 - WINDOW) for d, lo in where)
    if not lone or len(group) == 1:
        return
    for key, _, _ in group:
        for i in range(8, len(key) - WINDOW + 1):
            w = key[i : i + WINDOW]
            seen[w] = seen.get(w, 0) + 1
    for key, _, where in lone:
        (d, lo), first = where[0], None
        for i in range(8, len(key) - WINDOW + 1):
            if seen[key[i : i + WINDOW]] > 1:
                first = i if first is None else first
            elif first is not None:
                yield d, lo + first - 8, lo + i - 9
                first = None
        if first is not None:
            yield d, lo + first - 8, lo + len(key) - WINDOW - 8


def merge_items(blobs: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(document, first, last) window starts that repeat, from item runs."""
    group: list[list] = []
    for shared, key, many, d, lo in merge([read_run(b) for b in blobs]):
        place = [] if many else [(d, lo)]
        if group and shared == len(key) == len(group[-1][0]):
            group[-1][1] = True
            group[-1][2].extend(place)
            continue
        if group and shared < 8:
            yield from _settle(group)
            group = []
        group.append([key, many, place])
    yield from _settle(group)


def merge_digests(blobs: list[bytes]) -> list[np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*(_unpack(b, ("<u8", "<u8", "u1", "<i8", "<i4")) for b in blobs))]
    order = np.lexsort((columns[1], columns[0]))
    high, low, many, d, at = (c[order] for c in columns)
    first = np.ones(len(high), bool)
    first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    size = np.diff(np.append(np.flatnonzero(first), len(high)))
    found = np.repeat(size > 1, size) & (many == 0)
    return _ranges(d[found], at[found])


def merge_runs(sent: DataFrame) -> DataFrame:
    """``(d, first, last)`` from all runs of each part."""
    schema = pa.schema([("d", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def work(table: pa.Table) -> pa.Table:
        blobs: dict[int, list[bytes]] = {ITEMS: [], DIGESTS: [], PLACES: []}
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist()):
            blobs[kind].append(blob)
        out = [_unpack(b, ("<i8", "<i8", "<i8")) for b in blobs[PLACES]]
        if blobs[DIGESTS]:
            out.append(merge_digests(blobs[DIGESTS]))
        found = list(merge_items(blobs[ITEMS])) if blobs[ITEMS] else []
        if found:
            out.append([np.array(c, "<i8") for c in zip(*found)])
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, "<i8")] * 3
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types)], schema=schema)

    return sent.groupBy("part").applyInArrow(work, "d long, first int, last int")


# -- cutting ------------------------------------------------------------------


def cut_bytes(body: bytes, windows: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal stretches removed."""
    spans: list[list[int]] = []
    for first, last in sorted((w["first"], w["last"]) for w in windows):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + WINDOW)
        else:
            spans.append([first, last + WINDOW])
    kept, at = [], 0
    for a, b in spans:
        kept.append(body[at:a])
        at = b
    return b"".join([*kept, body[at:]]), [tuple(s) for s in spans]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` of every row.

    ``spans`` are the removed stretches, ``kept`` the bytes that stay.
    """
    ws = Workspace(docs.sparkSession, file_factor=1)
    body = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    # Rows of one id and text share their result, so one key serves both.
    rows = docs.select(F.xxhash64("doc_id", "text").alias("d"), "doc_id", body.alias("body"))
    items = ws.save(find_items(rows), rows=F.count(F.lit(1)))
    # Written, so that the join deals both sides anew and can split a hot anchor.
    counts = ws.save(items.df.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1")).df
    repeated = items.df.join(counts, "anchor").select("d", F.struct("anchor", "lo", "n", (F.col("c") > HOT).alias("hot")).alias("item"))
    lists = repeated.groupBy("d").agg(F.collect_set("item").alias("items"))
    parts = max(64, items.rows // PART_ITEMS)
    found = merge_runs(send_runs(rows.join(lists, "d"), parts))
    places = found.groupBy("d").agg(F.collect_set(F.struct("first", "last")).alias("windows"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in in_blocks(batches, text="body", size=8 << 20):
            bodies = [b.as_py() for b in batch.column("body")]
            done = [cut_bytes(b, w or []) for b, w in zip(bodies, batch.column("windows").to_pylist())]
            columns = [
                batch.column("doc_id"),
                pa.array([len(b) for b in bodies], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], kind),
                pa.array([k for k, _ in done], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return rows.join(places, "d", "left").select("d", "doc_id", "body", "windows").mapInArrow(cut, schema)


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(documents(spark, sf_dir))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

"""Hierarchical multi-length packing of token streams into training windows.

A document is cut into full windows and one remainder.  Remainders are routed to
the smallest context tier that holds them.  The plan is made on the histogram of
remainder lengths, which has at most one entry per length however many documents
there are: long windows are opened by the long remainders and their gaps filled
from shorter tiers, shorter tiers form windows that come out exactly full, and
what is left shares long windows.  A window that would stay too empty is given
up and its documents are cut into power-of-two windows and a short rest, so
padding stays small for every distribution of lengths.  Documents meet their
places by rank inside their length class; no document row passes the driver.

Defined results: a null text is an empty document (its end id alone); repeated
rows are packed as often as they occur; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.functions.scan import rank_within
from matloom.llm.common import bound_batches, documents, in_blocks
from matloom.llm.registry import query
from matloom.llm.tokens import END_ID, tokenizer
from matloom.runtime import Workspace

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
#: Rests below this are never cut again.
SHORTEST = 256
#: A window may stay empty by this share before its documents are cut instead.
MAX_PADDING = 1 / 64
#: Tokens of an optimiser step; windows are dealt out to steps of this size.
STEP_TOKENS = 64 * WINDOW

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# -- pieces -------------------------------------------------------------------


def _cuts(length: int, window: int, shortest: int) -> list[int]:
    """Power-of-two lengths of a cut remainder, largest first, then its rest."""
    out, size = [], window
    while size > shortest:
        size //= 2
        if length & size:
            out.append(size)
    rest = length % shortest
    return out + [rest] if rest else out


def pieces(docs: DataFrame, window: int, shortest: int, path: str | None) -> DataFrame:
    """Full windows and the remainder of each document, with checksums.

    ``cut_crc`` has the checksums of the pieces that :func:`_cuts` would make.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in in_blocks(batches):
            rows = []
            texts = batch.column("text").cast(pa.large_binary())
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids = memoryview(coder.encode(text.as_py()) + end)
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * min(n, start + window)]
                    crcs, at = [], 0
                    if len(piece) < 4 * window:
                        for size in _cuts(len(piece) // 4, window, shortest):
                            crcs.append(zlib.crc32(piece[4 * at : 4 * (at + size)]))
                            at += size
                    rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, crcs))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cut_crc"]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    bound_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(split, f"{PIECE}, cut_crc array<long>")


# -- plan ---------------------------------------------------------------------


@dataclass
class Plan:
    """Places of the items of each length class, by rank.

    ``whole``: (length, first rank, ranks, per window, first sequence, offset).
    ``cut``: (length, first rank, ranks, first sequence) of remainders cut up.
    ``rests``: as ``whole``, for the rests of cut remainders.
    """

    window: int
    whole: list[tuple] = field(default_factory=list)
    cut: list[tuple] = field(default_factory=list)
    rests: list[tuple] = field(default_factory=list)
    sequences: int = 0
    tokens: int = 0


class _Pool:
    """Counts of items left, found by size; a class is (size, parent, kind)."""

    def __init__(self):
        self.sizes: list[int] = []
        self.classes: dict[int, list[list]] = {}  # size -> [[parent, kind, next rank, count]]

    def add(self, size: int, parent: int, kind: str, rank: int, count: int) -> None:
        if size not in self.classes:
            insort(self.sizes, size)
            self.classes[size] = []
        self.classes[size].append([parent, kind, rank, count])

    def largest(self, most: int) -> int | None:
        at = bisect_right(self.sizes, most)
        return self.sizes[at - 1] if at else None

    def take(self, size: int, n: int) -> tuple[int, str, int]:
        head = self.classes[size][0]
        parent, kind, rank, count = head
        head[2], head[3] = rank + n, count - n
        if head[3] == 0:
            self.classes[size].pop(0)
            if not self.classes[size]:
                del self.classes[size]
                self.sizes.remove(size)
        return parent, kind, rank

    def count(self, size: int) -> int:
        return self.classes[size][0][3]


def _fill(pool: _Pool, first: int, capacity: int) -> tuple[list[tuple[int, int]], int]:
    """Best fit from the largest down: [(size, how many per window)] and the sum."""
    chosen, total, below = [(first, 1)], first, capacity - first
    used = {first: 1}
    limit = below
    while (size := pool.largest(min(limit, capacity - total))) is not None:
        fit = min((capacity - total) // size, pool.count(size) - used.get(size, 0))
        if fit > 0:
            used[size] = used.get(size, 0) + fit
            if size == first:
                chosen[0] = (first, used[size])
            else:
                chosen.append((size, fit))
            total += fit * size
        limit = size - 1
    return chosen, total


def _emit(plan: Plan, pool: _Pool, chosen: list[tuple[int, int]]) -> None:
    """As many equal windows as the classes have items for."""
    windows = min(pool.count(size) // per for size, per in chosen)
    offset = 0
    for size, per in chosen:
        parent, kind, rank = pool.take(size, per * windows)
        slots = plan.whole if kind == "whole" else plan.rests
        slots.append((parent, rank, per * windows, per, plan.sequences, offset, size))
        offset += per * size
    plan.sequences += windows
    plan.tokens += windows * (offset if offset & (offset - 1) == 0 else plan.window)


def make_plan(
    counts: dict[int, int],
    window: int = WINDOW,
    tiers: tuple[int, ...] = TIERS,
    shortest: int = SHORTEST,
    max_padding: float = MAX_PADDING,
) -> Plan:
    """Windows for ``counts`` items of each length (1 to ``window``)."""
    plan, pool = Plan(window), _Pool()
    for length, n in sorted(counts.items()):
        pool.add(length, length, "whole", 0, n)
    if window in pool.classes:
        _emit(plan, pool, [(window, 1)])
    # Long windows first, filled from the shorter tiers; a shorter tier keeps
    # only windows that come out full, as others would be padded.
    for tier in sorted(tiers, reverse=True):
        size = pool.largest(tier)
        while size is not None and size > tier // 2:
            chosen, total = _fill(pool, size, tier)
            if total == tier:
                _emit(plan, pool, chosen)
                size = pool.largest(size)
            else:
                size = pool.largest(size - 1)
    # The rest share long windows, or are cut when that leaves too much empty.
    while (size := pool.largest(window)) is not None:
        chosen, total = _fill(pool, size, window)
        if size >= shortest and window - total > max_padding * window:
            n = pool.count(size)
            parent, _, rank = pool.take(size, n)
            cuts = _cuts(size, window, shortest)
            full = [c for c in cuts if c >= shortest]
            plan.cut.append((parent, rank, n, plan.sequences, len(full)))
            plan.sequences += n * len(full)
            plan.tokens += n * sum(full)
            if len(full) < len(cuts):
                pool.add(cuts[-1], parent, "rest", rank, n)
        else:
            _emit(plan, pool, chosen)
    return plan


# -- placing ------------------------------------------------------------------


def _lookup(slots: list[tuple]) -> dict[int, tuple[np.ndarray, list[tuple]]]:
    by: dict[int, list[tuple]] = {}
    for s in sorted(slots):
        by.setdefault(s[0], []).append(s)
    return {k: (np.array([s[1] for s in v]), v) for k, v in by.items()}


def _slot(table: dict, length: int, rank: int) -> tuple | None:
    if length not in table:
        return None
    firsts, slots = table[length]
    at = int(np.searchsorted(firsts, rank, "right")) - 1
    return slots[at] if at >= 0 and rank < slots[at][1] + slots[at][2] else None


def place(ranked: DataFrame, plan: Plan, shortest: int = SHORTEST, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces with their sequence, offset, window and step."""
    # The plan has a few entries per length below the window, not per document.
    whole, cut, rests = _lookup(plan.whole), _lookup(plan.cut), _lookup(plan.rests)
    window, steps = plan.window, max(1, -(-plan.tokens // step_tokens))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []

            def laid(doc, start, length, crc, n, slot, rank):
                _, first, _, per, sequence, offset, size = slot
                seq, place = divmod(rank - first, per)
                rows.append((doc, start, length, crc, n, sequence + seq, offset + place * size, (sequence + seq) % steps))

            columns = (batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cut_crc", "rank"))
            for doc, start, length, crc, n, crcs, rank in zip(*columns):
                if slot := _slot(whole, length, rank):
                    laid(doc, start, length, crc, n, slot, rank)
                    continue
                _, first, _, sequence, full = _slot(cut, length, rank)
                at = 0
                for k, (size, c) in enumerate(zip(_cuts(length, window, shortest), crcs)):
                    if k < full:
                        seq = sequence + (rank - first) * full + k
                        rows.append((doc, start + at, size, c, n, seq, 0, seq % steps))
                    else:
                        laid(doc, start + at, size, c, n, _slot(rests, length, rank), rank)
                    at += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_id"]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return ranked.mapInArrow(assign, f"{PIECE}, sequence_id long, offset long, step_id long")


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    tiers: tuple[int, ...] = TIERS,
    shortest: int = SHORTEST,
    max_padding: float = MAX_PADDING,
    step_tokens: int = STEP_TOKENS,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    A sequence is padded to ``window`` unless it is a power of two long.
    ``step_id`` deals the sequences of each length round the steps, so steps
    hold nearly equal numbers of tokens and the same mix of lengths.
    """
    ws = Workspace(docs.sparkSession, file_factor=1)
    cut = ws.save(pieces(docs, window, shortest, vocabulary))
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    ranked = ws.save(rank_within(ws, cut.df, ["length"], order, "rank"))
    counts = {r["length"]: r["n"] for r in ranked.df.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(counts, window, tiers, shortest, max_padding)
    return place(ranked.df, plan, shortest, step_tokens)


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))

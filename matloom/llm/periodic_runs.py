"""Periodic runs of words, found in an enhanced suffix array.

A run is a stretch of words with smallest period ``q`` that no neighbour extends.
The words of a batch of texts become numbers that differ between texts, so one
suffix array holds the suffixes of each text side by side and nothing matches
across texts.  A run of period ``q`` ends in exactly one *branching* square: two
equal halves of ``q`` words whose next words differ.  Its two halves are suffixes
in different children of the LCP interval of depth ``q``.  So for each interval
the suffixes of all children but the largest are asked whether the suffix
``q`` places before or behind lies in the same interval, which the inverse suffix
array tells; intervals are ranges of ranks, no tree is built.  Each square found
is rotated to the left as long as it stays a square, and all its rotations merge
into the run.

Suffixes are sorted by prefix doubling, only where prefixes still repeat.  LCP
values are compared at irreducible places alone and follow elsewhere.  A run of
at least ``least`` words repeats a sequence of two thirds of that; texts without
any such repeat hold no run and are not looked at further.

Defined results: a null or empty text has no words and no runs; the collapsed
text is never null; repeated rows are judged one by one; an empty table gives an
empty result; a kept column with the name of a result column gives way to it,
other columns are ignored.  A null doc_id plants nothing in the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy as copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from matloom.llm.common import bound_batches, documents, in_blocks, let, slices, words_of
from matloom.llm.registry import query

#: Words of a run, and how often its period fits in it, at least.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Cells compared or tested at a time.
CELLS = 1 << 20
#: Bytes of text of which one suffix array is made; a longer text has its own.
BLOCK_BYTES = 1 << 20

RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
RESULT = ("n_words", "runs", "collapsed")


# -- enhanced suffix array ----------------------------------------------------


def suffix_array(codes: np.ndarray, ends: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """``(ranks, repeated)`` of all suffixes; a suffix stops at its ``ends``.

    ``repeated`` marks the places whose next ``known`` codes (or more, up to the
    next power of two) occur again.  Codes differ between texts.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    head = np.append(True, np.diff(codes[order]) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    live = order[~(head & np.append(head[1:], True))]
    repeated, width = None, 1
    while True:
        if repeated is None and (2 * width > known or not len(live)):
            repeated = np.zeros(n, bool)
            repeated[live] = True
        if not len(live):
            return rank, repeated
        after = live + width
        inside = after < ends[live]
        behind = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        own = rank[live]
        by = np.argsort(own * (n + 1) + behind)
        live, own, behind = live[by], own[by], behind[by]
        group = np.append(True, np.diff(own) != 0)
        part = group | np.append(True, np.diff(behind) != 0)
        at = np.arange(len(live))
        first = np.maximum.accumulate(np.where(group, at, 0))
        rank[live] = own + np.maximum.accumulate(np.where(part, at, 0)) - first
        live = live[~(part & np.append(part[1:], True))]
        width *= 2


def agreeing(padded: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many codes agree from places ``a`` and ``b`` on, in direction ``step``.

    ``padded`` has a code of its own at both ends; places count from the first
    real code.
    """
    out = np.zeros(len(a), np.int64)
    live, width = np.arange(len(a)), 8
    while len(live):
        open_ = []
        for i in range(0, len(live), max(1, CELLS // width)):
            part = live[i : i + max(1, CELLS // width)]
            offset = 1 + step * (out[part, None] + np.arange(width))
            last = len(padded) - 1
            x = padded[np.clip(a[part, None] + offset, 0, last)]
            same = x == padded[np.clip(b[part, None] + offset, 0, last)]
            n = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[part] += n
            open_.append(part[n == width])
        live, width = np.concatenate(open_), min(2 * width, CELLS)
    return out


def lcp_array(padded: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Common words of each suffix with the one of the next lower rank."""
    n = len(suffixes)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    # One less than at the place before, unless the words in front differ.
    place = np.arange(n)
    fresh = (before < 0) | (padded[place] != padded[before])
    fresh[0] = True
    at = np.flatnonzero(fresh & (before >= 0))
    at = at[padded[at + 1] == padded[before[at] + 1]]
    value = np.zeros(n, np.int64)
    value[at] = agreeing(padded, at, before[at], 1)
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    return (value[last] - (place - last))[suffixes]


def small_children(lcp: list[int]) -> tuple[np.ndarray, ...]:
    """``(from, to, depth, low, high)``: rank ranges of all children but the
    largest of each LCP interval, and the ranks of the interval."""
    depths, sizes, cuts = [], [], []
    stack: list[tuple[int, list[int]]] = []
    for k, d in enumerate([*lcp[1:], 0], 1):
        low = k - 1
        while stack and stack[-1][0] > d:
            depth, own = stack.pop()
            own.append(k)
            depths.append(depth)
            sizes.append(len(own))
            cuts += own
            low = own[0]
        if d:
            if stack and stack[-1][0] == d:
                stack[-1][1].append(k)
            else:
                stack.append((d, [low, k]))
    if not depths:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    cut, size = np.array(cuts), np.array(sizes)
    end = np.cumsum(size)
    child = np.ones(len(cut), bool)
    child[end - 1] = False  # the last cut of an interval opens no child
    begin, owner = np.flatnonzero(child), np.repeat(np.arange(len(size)), size - 1)
    width = cut[begin + 1] - cut[begin]
    # Of each interval the first of its widest children is passed over.
    widest = np.lexsort((-width, owner))[np.cumsum(size - 1) - (size - 1)]
    keep = np.ones(len(begin), bool)
    keep[widest] = False
    begin, owner = begin[keep], owner[keep]
    return cut[begin], cut[begin + 1], np.array(depths)[owner], cut[end - size][owner], cut[end - 1][owner]


def branching_squares(padded: np.ndarray, suffixes: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(end, period)`` of all squares whose halves are followed by different words."""
    n = len(suffixes)
    lo, hi, depth, low, high = small_children(lcp.tolist())
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    total = np.cumsum(hi - lo)
    first = 0
    while first < len(lo):
        until = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CELLS, "right")))
        count = (hi - lo)[first:until]
        own = np.repeat(np.arange(first, until), count)
        r = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + lo[own]
        d = depth[own]
        for sign in (1, -1):
            other = suffixes[r] + sign * d
            at = rank[np.clip(other, 0, n - 1)]
            hit = (other >= 0) & (other < n) & (low[own] <= at) & (at < high[own])
            start, period = np.minimum(suffixes[r], other)[hit], d[hit]
            branch = padded[start + period + 1] != padded[np.minimum(start + 2 * period, n) + 1]
            found.append(((start + 2 * period)[branch], period[branch]))
        first = until
    end, period = (np.concatenate(x) for x in zip(*found))
    both = np.unique(np.stack([end, period], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def merged_runs(padded: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of the runs of squares sorted by end and period."""
    out = [(np.empty(0, np.int64),) * 3]
    while len(end):
        head = np.append(True, np.diff(end) != 0)
        e, q = end[head], period[head]
        back = agreeing(padded, e - 2 * q - 1, e - q - 1, -1)
        out.append((e - 2 * q - back, 2 * q + back, q))
        # Squares of a multiple of the period inside the run are the same run.
        own = np.cumsum(head) - 1
        same = (period % q[own] == 0) & (2 * period <= (2 * q + back)[own])
        end, period = end[~same], period[~same]
    return tuple(np.concatenate(x) for x in zip(*out))


def periodic_runs(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Rows ``(start, length, period)`` by start and period, places of the batch.

    Text ``k`` is ``codes[bounds[k]:bounds[k + 1]]``; codes differ between texts.
    """
    none = np.empty((0, 3), np.int64)
    if not len(codes):
        return none
    length = np.diff(bounds)
    ends = np.repeat(bounds[1:], length)
    # Length - period words repeat at least, with period <= length / times.
    shortest = least - least // times
    rank, repeated = suffix_array(codes, ends, shortest)
    text = np.repeat(np.arange(len(length)), length)
    chosen = np.zeros(len(length), bool)
    chosen[text[repeated]] = True
    if not chosen.any():
        return none
    # The suffixes of a text have the ranks that its places have.
    places = np.flatnonzero(chosen[text])
    moved = np.cumsum(chosen[text]) - 1
    rank = moved[rank[places]]
    suffixes = np.empty(len(places), np.int64)
    suffixes[rank] = np.arange(len(places))
    padded = np.concatenate([[-1], codes[places], [-1]])
    squares = branching_squares(padded, suffixes, rank, lcp_array(padded, suffixes))
    start, n, q = merged_runs(padded, *squares)
    keep = (n >= least) & (n >= times * q)
    start, n, q = places[start[keep]], n[keep], q[keep]
    return np.stack([start, n, q], axis=1)[np.lexsort((q, start))]


# -- texts --------------------------------------------------------------------


def encoded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, rising from text to text, and where each text begins."""
    known: dict[bytes, int] = {}
    bounds = np.cumsum([0, *map(len, texts)])
    number = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(bounds[-1]))
    return number + np.repeat(np.arange(len(texts)), np.diff(bounds)) * len(known), bounds


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words outside the repetitions of all runs, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, keep: list[str], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """Columns ``keep`` of every row with ``n_words``, the ``runs`` of its text by
    start and period, and the ``collapsed`` text, which has each run's first
    period only."""
    keep = [c for c in keep if c not in RESULT]
    free = _free("text", keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(slices(batches, 4096), free, BLOCK_BYTES):
            texts = [(t.as_py() or b"").split() for t in batch.column(free).cast(pa.large_binary())]
            codes, bounds = encoded(texts)
            runs = periodic_runs(codes, bounds, least, times)
            cut = np.searchsorted(runs[:, 0], bounds)
            runs[:, 0] -= np.repeat(bounds[:-1], np.diff(cut))
            spans = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"])
            rest = [collapsed(t, runs[a:b]) for t, a, b in zip(texts, cut, cut[1:])]
            new = [
                pa.array(np.diff(bounds)),
                pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), spans),
                pa.array(rest, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, *RESULT])

    bound_batches(docs)
    rows = docs.select(*keep, F.col("text").alias(free))
    schema = copy(rows.drop(free).schema).add("n_words", LongType()).add("runs", ArrayType(RUN)).add("collapsed", StringType())
    return rows.mapInArrow(work, schema)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


# -- query --------------------------------------------------------------------


def with_repetitions(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where the end of every tenth text repeats itself."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def repeat(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        spots = F.sequence(F.lit(0), n - 1)

        def joined(edge: Column) -> Column:
            a, p = edge["a"], edge["p"]
            word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))
            return F.concat_ws(" ", F.transform(spots, word))

        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), joined)).otherwise("")

    return docs.select("doc_id", F.when(h % 10 == 0, let(words_of(F.col("text")), repeat)).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = find_runs(with_repetitions(documents(spark, sf_dir)), ["doc_id"])
    none = F.lit(None).cast(RUN)
    longer = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    best = F.aggregate("runs", none, lambda a, x: F.when(longer(a, x), x).otherwise(a))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return runs.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )

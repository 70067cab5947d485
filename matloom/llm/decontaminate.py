"""Benchmark decontamination with SimHash windows of each item's size.

A benchmark item is its multiset of five-word shingles.  Windows of a document
that have as many words as an item get a SimHash of their shingles; a
multi-index over ``RADIUS + 1`` blocks of fingerprint bits returns every item of
that size within ``RADIUS`` bits, since that many differing bits leave at least
one block untouched.  Returned pairs are verified by the exact weighted Jaccard
similarity of the two multisets.  A document with fewer words than an item is
itself the one window compared with it.

Only windows that can reach the similarity are fingerprinted: of equally many
shingles a window must share at least ``2s / (1 + s)`` with an item, so runs of
shingles known from items of that size are located first.

The benchmark is worked off in blocks of bounded size; each block is compared
with all documents, which are not shuffled.

Defined results: null and empty texts contain nothing; items of fewer than five
words have no shingle and match nothing; repeated rows and items are compared
one by one; an empty table on either side gives an empty result; of windows
equally similar the first is reported; other columns are ignored (the search) or
kept (the filter).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.llm.common import bound_batches, documents, in_blocks
from matloom.llm.registry import query

SHINGLE = 5
MIN_SIMILARITY = 0.8
#: Bits in which the fingerprints of a window and an item may differ.
RADIUS = 20
#: Bytes of benchmark text that are held by a task at a time.
BLOCK_BYTES = 8 << 20
#: Bytes of a document whose words are held at a time.
PART_BYTES = 4 << 20
SEED = 42

RESULT = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def words(text: str | bytes | None) -> list[bytes]:
    raw = (text or b"") if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")
    return raw.lower().split()


def _shingles(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``SHINGLE`` word codes."""
    n = len(codes) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(32))


def _codes(tokens: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, tokens, repeat(SEED)), np.uint64, len(tokens))


def _own_codes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)


def simhash(shingles: np.ndarray) -> int:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles), bitorder="little").view("<u8")[0])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared over combined multiplicities."""
    shared = sum((a & b).values())
    combined = a.total() + b.total() - shared
    return shared / combined if combined else 0.0


class BlockIndex:
    """Fingerprints by the value of each of ``RADIUS + 1`` blocks of bits."""

    def __init__(self, prints: dict[int, int], radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        edges = [64 * k // (radius + 1) for k in range(radius + 2)]
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
        self.tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in self.blocks]
        for key, p in prints.items():
            for (shift, mask), table in zip(self.blocks, self.tables):
                table[p >> shift & mask].append(key)

    def near(self, p: int) -> list[tuple[int, int]]:
        """``(key, distance)`` of all fingerprints within the radius."""
        met = set()
        for (shift, mask), table in zip(self.blocks, self.tables):
            met.update(table.get(p >> shift & mask, ()))
        found = ((k, (p ^ self.prints[k]).bit_count()) for k in met)
        return sorted((k, d) for k, d in found if d <= self.radius)


class Benchmark:
    """Items ready for the search, held by every task."""

    def __init__(self, items: list[tuple[int, str]], least: float = MIN_SIMILARITY, radius: int = RADIUS):
        self.least = least
        self.ids, self.sets = [], []
        sizes: dict[int, list[int]] = defaultdict(list)
        for item, text in items:
            tokens = words(text)
            if len(tokens) >= SHINGLE:
                sizes[len(tokens)].append(len(self.ids))
                self.ids.append(item)
                self.sets.append(Counter(_shingles(_codes(tokens)).tolist()))
        self.longest = max(sizes, default=0)
        known: dict[int, set[int]] = {n: {h for k in ks for h in self.sets[k]} for n, ks in sizes.items()}
        self.known = {n: np.array(sorted(h), np.uint64) for n, h in known.items()}
        every = set().union(*known.values()) if known else set()
        self.all = np.array(sorted(every), np.uint64)
        self.texts = [words(text) for _, text in items]
        self.quick: tuple[np.ndarray, np.ndarray] | None = None
        prints = {k: simhash(np.array(list(s.elements()), np.uint64)) for k, s in enumerate(self.sets)}
        self.index = {n: BlockIndex({k: prints[k] for k in ks}, radius) for n, ks in sizes.items()}

    def touched(self, texts: list[list[bytes]]) -> list[int]:
        """Numbers of the texts that share a shingle with any item.

        Python's own string hash, which differs between processes, is enough to
        pass over the rest; whatever it lets through is searched exactly.
        """
        if self.quick is None:
            hashes = [_shingles(_own_codes(t)) for t in self.texts]
            known = np.unique(np.concatenate([*hashes, np.empty(0, np.uint64)]))
            bits = np.zeros(1 << max(16, (64 * len(known)).bit_length()), bool)
            bits[(known & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.quick = known, bits
        known, bits = self.quick
        # Shingles across two texts are candidates too many at worst.
        s = _shingles(_own_codes([w for t in texts for w in t]))
        near = np.flatnonzero(bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)])
        ends = np.cumsum([len(t) for t in texts])
        return np.unique(np.searchsorted(ends, near[np.isin(s[near], known)], "right")).tolist()

    def search(self, tokens: list[bytes], whole: bool = True) -> Iterator[tuple[int, int, int, int, float]]:
        """(item, first word, words, distance, similarity) of verified windows.

        ``whole`` tokens are all of a text, and are judged as they are by items
        that have more; in a part of a text they are only its end.
        """
        s = _shingles(_codes(tokens))
        if not len(s) or not len(self.all):
            return
        spots = np.flatnonzero(np.isin(s, self.all))
        for n, known in self.known.items() if len(spots) else ():
            size = n - SHINGLE + 1
            here = spots[np.isin(s[spots], known)]
            short = len(s) < size
            # Of fewer shingles, the item's share alone bounds the similarity.
            share = self.least if short else 2 * self.least / (1 + self.least)
            need = int(np.ceil(size * share - 1e-9))
            if len(here) < need or short and not whole:
                continue
            if short:
                yield from self._verified(n, s, 0, len(tokens))
                continue
            # Starts of windows that hold `need` known shingles.
            first, last = here[: len(here) - need + 1], here[need - 1 :]
            lows, highs = np.maximum(last - size + 1, 0), np.minimum(first, len(s) - size)
            fits = lows <= highs
            change = np.bincount(lows[fits], minlength=len(s) - size + 2) - np.bincount(highs[fits] + 1, minlength=len(s) - size + 2)
            for at in np.flatnonzero(np.cumsum(change)).tolist():
                yield from self._verified(n, s[at : at + size], at, n)

    def _verified(self, n: int, window: np.ndarray, at: int, length: int) -> Iterator[tuple[int, int, int, int, float]]:
        """Items of ``n`` words that the window of ``length`` words at ``at`` holds."""
        candidates = self.index[n].near(simhash(window))
        if candidates:
            own = Counter(window.tolist())
            for k, distance in candidates:
                if (sim := similarity(own, self.sets[k])) >= self.least:
                    yield k, at, length, distance, sim


def parts(text: bytes, overlap: int, size: int = PART_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Words of a text in parts that share ``overlap`` words, with their numbers."""
    at, number, carried = 0, 0, []
    while at < len(text):
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        tokens = carried + words(text[at:end])
        yield number - len(carried), tokens
        number += len(tokens) - len(carried)
        carried = tokens[-overlap:] if overlap else []
        at = end


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best window of each document for each item that it contains."""
    found = docs.sparkSession.createDataFrame([], RESULT)
    for bench in _blocks(benchmark, least, radius, block_bytes):
        found = found.unionByName(_search(docs, bench))
    return found


def _blocks(benchmark: DataFrame, least: float, radius: int, block_bytes: int) -> Iterator[Benchmark]:
    """The items in blocks of bounded size."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(total) // block_bytes)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield Benchmark([tuple(r) for r in part], least, radius)


def _best(batch: pa.RecordBatch, bench: Benchmark) -> dict[tuple[int, int], tuple]:
    """The best window by row of the batch and number of the item."""
    raw = [t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary())]
    overlap = max(0, bench.longest - 1)
    cut = [(k, number, tokens) for k, text in enumerate(raw) for number, tokens in parts(text, overlap)]
    # A text shorter than an item is carried whole into its last part.
    last = {k: c for c, (k, _, _) in enumerate(cut)}
    best: dict[tuple[int, int], tuple] = {}
    for c in bench.touched([tokens for _, _, tokens in cut]):
        d, number, tokens = cut[c]
        for k, at, n, distance, sim in bench.search(tokens, number == 0 and last[d] == c):
            if (d, k) not in best or (-sim, number + at) < (-best[d, k][4], best[d, k][1]):
                best[d, k] = (bench.ids[k], number + at, n, distance, sim)
    return best


def _search(docs: DataFrame, bench: Benchmark) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches):
            ids, best = batch.column("doc_id").to_pylist(), _best(batch, bench)
            rows = [(ids[d], *best[d, k]) for d, k in sorted(best)]
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
            columns = list(zip(*rows)) or [()] * 6
            names = ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    bound_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(work, RESULT)


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = MIN_SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` that contain no benchmark item, with their own columns.

    The task that reads a row decides on it, so no text is shuffled and no key
    stands for a row.
    """
    bound_batches(docs)
    kept = docs
    for bench in _blocks(benchmark, least, radius, block_bytes):
        kept = kept.mapInArrow(_clean_rows(bench), docs.schema)
    return kept


def _clean_rows(bench: Benchmark) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches):
            leaks = {d for d, _ in _best(batch, bench)}
            yield batch.filter(pa.array([k not in leaks for k in range(batch.num_rows)], pa.bool_())) if leaks else batch

    return work


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

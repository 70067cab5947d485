"""Front-coded sorted runs of byte strings, and their merge by a loser tree.

A run stores each string as the length it shares with its predecessor and the
rest.  While runs are merged, every candidate knows how long a prefix it shares
with the string written last; of two candidates the one that shares more is the
smaller, and equal lengths are compared only beyond the shared prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to ``start``."""
    low, high, step = start, min(len(a), len(b)), 8
    # Gallop over equal stretches, then halve the first stretch that differs.
    while low < high and a[low : low + step] == b[low : low + step]:
        low += step
        step *= 4
    if low >= high:
        return high
    high = min(high, low + step)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


_COLUMNS = (("shared", "<u2"), ("size", "<u2"), ("many", "u1"), ("doc", "<i8"), ("start", "<i4"))


def pack_run(entries: list[tuple[bytes, bool, int, int]]) -> bytes:
    """Front-code sorted ``(string, many, doc, start)`` entries and compress them."""
    shared, rest, before = [], [], b""
    for key, *_ in entries:
        n = common_prefix(before, key)
        shared.append(n)
        rest.append(key[n:])
        before = key
    columns = [shared, [len(r) for r in rest], *zip(*(e[1:] for e in entries))]
    body = b"".join([np.array(c, kind).tobytes() for c, (_, kind) in zip(columns, _COLUMNS)] + rest)
    head = np.array([len(entries), len(body)], "<i8").tobytes()
    return head + pa.Codec("zstd").compress(body, asbytes=True)


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, bool, int, int]]:
    """``(shared, string, many, doc, start)`` in order."""
    n, size = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    body, at, columns = pa.Codec("zstd").decompress(blob[16:], size, asbytes=True), 0, []
    for _, kind in _COLUMNS:
        columns.append(np.frombuffer(body, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    before = b""
    for shared, length, many, doc, start in zip(*columns):
        before = before[:shared] + body[at : at + length]
        at += length
        yield shared, before, bool(many), doc, start


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge runs to ``(shared with the string before, string, ...)`` in order."""
    k = max(1, len(runs))
    size = 1 << (k - 1).bit_length()
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    keys = [h[1] if h else None for h in heads]
    shared = [0] * size
    tree = [0] * size  # losers by inner node; the winner is kept apart

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads."""
        x, y = keys[a], keys[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = shared[a], shared[b]
        if p > q:
            return a, b
        if p < q:
            return b, a
        n = common_prefix(x, y, p)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    winners = list(range(size))
    node = size
    while len(winners) > 1:
        node //= 2
        level = []
        for i in range(0, len(winners), 2):
            w, loser = play(winners[i], winners[i + 1])
            tree[node + i // 2] = loser
            level.append(w)
        winners = level
    w = winners[0]
    while keys[w] is not None:
        yield (shared[w], *heads[w][1:])
        heads[w] = head = next(runs[w], None)
        keys[w], shared[w] = (head[1], head[0]) if head else (None, 0)
        node = (size + w) // 2
        while node:
            w, tree[node] = play(w, tree[node])
            node //= 2

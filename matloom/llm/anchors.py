"""Anchored runs of fixed-size byte windows.

Every window of ``WINDOW`` bytes is assigned the position of the smallest hash
among the ``GRAM``-byte strings inside it.  The choice depends on the window's
bytes alone, so equal windows have equal anchors at equal offsets, wherever they
lie.  Neighbouring windows mostly share an anchor; such a run is one item, the
string from its first window's begin to its last window's end.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WINDOW = 200
GRAM = 32
#: Bytes hashed at a time; longer texts are taken in overlapping parts.
BLOCK = 1 << 20

# Odd bases and mixing constants.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


@lru_cache(maxsize=2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    n = BLOCK + 2 * WINDOW + 1
    out = []
    for base in (base, pow(base, -1, 1 << 64)):
        p = np.empty(n, np.uint64)
        p[0] = 1
        p[1:] = base
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _MIX1
    h ^= h >> np.uint64(29)
    h *= _MIX2
    h ^= h >> np.uint64(32)
    return h


class Hashes:
    """Position-independent hashes of all substrings of a buffer."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        power, self.inverse = _powers(base)
        self.before = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.before[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.before[end] - self.before[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.before) - size
        return _mix((self.before[size:] - self.before[:n]) * self.inverse[:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Items of the texts that lie one after the other in ``data``.

    ``ends`` are the texts' ends.  Returns, per item, the begin of its first
    window, its number of windows and the hash of its anchor string.
    """
    empty = np.empty(0, np.int64)
    if len(data) < WINDOW:
        return empty, empty, empty
    hashes = Hashes(data)
    gram = hashes.grams(GRAM)
    low = np.uint64(0xFFFFFFFF)
    least = _sliding_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), WINDOW - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    # Windows that reach into the next text do not exist.
    begins = np.concatenate([[0], ends[:-1]])
    alive = np.zeros(len(anchor) + 1, np.int32)
    inside = ends - WINDOW >= begins
    np.add.at(alive, begins[inside], 1)
    np.add.at(alive, ends[inside] - WINDOW + 1, -1)
    alive = np.cumsum(alive[:-1]) > 0
    anchor = np.where(alive, anchor, -1)
    cut = np.ones(len(anchor), bool)
    cut[1:] = anchor[1:] != anchor[:-1]
    cut[begins[begins < len(cut)]] = True
    first = np.flatnonzero(cut)
    n = np.diff(np.append(first, len(anchor)))
    live = anchor[first] >= 0
    first, n = first[live], n[live]
    return first, n, gram[anchor[first]].view(np.int64)

"""Periodic runs against brute force, and the query's digests from its definition."""

import hashlib
import random
import time
import zlib

import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from matloom.llm import periodic_runs as P
from matloom.llm.queries import QUERIES


def brute(words, least=24, times=3):
    """All runs ``(start, length, period)`` of a list of words, from the definition."""
    n, found = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, times * q) and not any(words[i : i + size - p] == words[i + p : i + size] for p in range(1, q)):
                found.add((i, size, q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(texts, least=24, times=3):
    codes, bounds = P.encoded(texts)
    rows = P.periodic_runs(codes, bounds, least, times).tolist()
    return [[(s - a, n, q) for s, n, q in rows if a <= s < b] for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=40), max_size=4), st.sampled_from([(24, 3), (6, 3), (4, 2)]))
def test_small_alphabets(texts, form):
    texts = [[c.encode() for c in t] for t in texts]
    assert runs_of(texts, *form) == [brute(t, *form) for t in texts]


def test_repeated_ends():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 120)
        words = [b"%d" % rng.randrange(rng.choice([2, 5, 50])) for _ in range(n)]
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        assert runs_of([words, words[: n // 2], words]) == [brute(words), brute(words[: n // 2]), brute(words)]


@pytest.mark.parametrize("unit", [1, 2, 1000])
def test_long_texts_take_near_linear_time(unit):
    begin = time.perf_counter()
    n = 300_000
    assert runs_of([[b"%d" % (i % unit) for i in range(n)]]) == [[(0, n, unit)]]
    assert time.perf_counter() - begin < 30


def test_rows(spark):
    line = "x y z " * 10
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, line, None), (None, "é " * 30 + "end", "c"), (4, "one word " + "k " * 23, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = P.find_runs(docs, ["doc_id", "runs"])
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    out = sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got.collect()), key=repr)
    assert out == sorted(
        [
            (1, 0, [], ""),
            (2, 0, [], ""),
            (2, 0, [], ""),
            (3, 30, [(0, 30, 3)], "x y z"),
            (None, 31, [(0, 30, 1)], "é end"),
            (4, 25, [], "one word " + " ".join(["k"] * 23)),
        ],
        key=repr,
    )
    assert P.find_runs(docs.limit(0), ["doc_id"]).count() == 0


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    if n >= 500:  # brute force is too slow
        return None
    runs = brute(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    rest = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def test_query_follows_the_definition(spark):
    got = {r[0]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    want = [w for d in docs if (w := expected(*d))]
    assert len(want) > 100 and sum(w[1] for w in want) > 5
    for w in want:
        assert got[w[0]] == w

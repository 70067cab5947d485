"""Sketches of shingle sets and the order of shingles of the near-duplicate stage."""

import numpy as np
from test_near_dedup import brute_kept

from matloom.llm import similar_texts
from matloom.llm.simhash import keep_one


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    for size in (1, 2, 63, 64, 65, 130, 1000, 5000):
        a = np.unique(rng.integers(0, 2**64, size, np.uint64))
        for drop, more in ((0, 0), (1, 0), (size // 5, size // 7), (0, 3 * size), (size - 1, 0)):
            b = np.union1d(a[drop:], rng.integers(0, 2**64, more, np.uint64))
            differ = len(np.setxor1d(a, b))
            x, y = similar_texts.sketch(a), similar_texts.sketch(b)
            assert similar_texts.apart(x, y) == similar_texts.apart(y, x) <= differ
            assert not drop + more or similar_texts.apart(x, y) >= min(differ, 64) / 8 or differ < 8


def test_only_sets_that_may_be_similar_are_compared(spark, monkeypatch):
    """Texts that share half of their words meet, but their sets are not moved."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{int(i)}" for i in rng.integers(0, 10**6, n)]
    passage, texts = word(100), []
    for _ in range(30):
        texts.append(" ".join(passage + word(100)))
    texts += [texts[0] + " more", texts[1] + " of them"]
    rows = list(enumerate(texts))
    met, compared, real, similar = [], [], similar_texts._still_mixed, similar_texts._similar
    monkeypatch.setattr(similar_texts, "FREQUENT", 10**9)
    monkeypatch.setattr(similar_texts, "_still_mixed", lambda *args: met.append(1) or real(*args))
    monkeypatch.setattr(similar_texts, "_similar", lambda pairs, *args: compared.append(pairs.rows) or similar(pairs, *args))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == brute_kept(rows)
    assert met and sum(compared) <= 4


def test_sets_that_share_many_keys_meet_in_one(spark):
    """Rows of keys: four sets with 50 keys in common, two of them with one more before."""
    rows = [(k, x, 200, k + (x < 2), 0, x) for k in range(50) for x in range(4)] + [(99, x, 200, 0, 0, x) for x in range(2)]
    keys = spark.createDataFrame(rows, "key long, set long, n long, i int, share int, group long")
    left = {(r["key"], r["set"]) for r in similar_texts.first_of_lists(keys).collect()}
    assert left == {(0, x) for x in range(4)} | {(99, 0), (99, 1)}
    words = lambda x: [(1 << 50) - 1 if x == 3 else x] * similar_texts.WORDS
    sketches = spark.createDataFrame([(x, words(x)) for x in range(4)], "set long, words array<long>")
    pairs = sorted((r["a"], r["b"]) for r in similar_texts.open_pairs(keys, 0.8, sketches).collect())
    assert pairs == [(0, 1), (0, 2), (1, 2)]

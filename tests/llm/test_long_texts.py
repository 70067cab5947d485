"""Texts of more than one hashing block beside empty ones."""

import numpy as np

from matloom.llm import suffix_dedup
from matloom.llm.anchors import BLOCK


def test_empty_texts_before_one_of_several_blocks(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = noise(500)
    long = noise(BLOCK - 250) + passage + noise(BLOCK) + noise(1000)
    texts = [(1, ""), (2, None), (3, long), (4, ""), (5, "x" + passage + "y"), (6, "short")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [tuple(s) for s in got[3]["spans"]] == [(BLOCK - 250, BLOCK + 250)]
    assert [tuple(s) for s in got[5]["spans"]] == [(1, 501)] and bytes(got[5]["kept"]) == b"xy"
    assert all(not got[d]["spans"] and got[d]["n_bytes"] == len(t or "") for d, t in texts if d not in (3, 5))

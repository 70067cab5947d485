"""Token alignment against whole-text encoding and the definition of its numbers."""

import hashlib
import random
from collections import Counter

import numpy as np
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from matloom.llm import token_alignment as T
from matloom.llm.queries import QUERIES
from matloom.runtime import Workspace


def whole(text):
    """``(id, end)`` of both sides by encoding the whole text; None without tokens."""
    e = T.pair_encoder()
    if not text:
        return None
    a, b = e.a.encode(" " + text, add_special_tokens=False).ids, e.b.encode(text)
    joined = [b"".join(e.a_bytes[i] for i in a), b"".join(e.b_bytes[i] for i in b)]
    if joined != [(" " + text).encode()] * 2:
        return None
    return list(zip(a, np.cumsum(e.a_length[a]).tolist())), list(zip(b, np.cumsum(e.b_length[b]).tolist()))


def cut_up(side, cuts):
    out = [[]]
    for i, end in side:
        out[-1].append(i)
        if end in cuts:
            out.append([])
    return out[:-1]


def expected(texts):
    """``(n_a, n_b, n_groups, n_links, n_best, count_sum, digest)`` of every text."""
    rows, count = [], Counter()
    for text in texts:
        sides = whole(text)
        if sides is None:
            rows.append(None)
            continue
        a, b = sides
        cuts = {e for _, e in a} & {e for _, e in b}
        groups = [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(cut_up(a, cuts), cut_up(b, cuts))]
        at = dict((e, i) for i, e in a)
        links = [(at[e], i) for i, e in b if e in at]
        count.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            links = r[3]
            out.append((*r[:3], len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), r[4]))
    return out


PARTS = st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "Zebra", "é", "▁", "\x1c", " ", "1234", "!!", "<|endoftext|>", "<s>", "ﬁ", "日本", "😀", "'s", "\x00", "́"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_chunks_give_the_ids_of_the_whole_text(text):
    got, want = T.pair_encoder().encode(text), whole(text)
    if want is None:
        assert got is None
    else:
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[i for i, _ in s] for s in want]


def test_memory_never_changes_ids():
    e = T.pair_encoder()
    small = T.PairEncoder(*map(__import__("public_tokenizers").path, (T.BYTE_VOCABULARY, T.PIECE_VOCABULARY)), capacity=3)
    rng = random.Random(5)
    for _ in range(50):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "x" * 100]) for _ in range(8))
        assert small.encode(text) == e.encode(text)


def test_a_chunk_met_before_is_not_aligned_again(monkeypatch):
    e = T.PairEncoder(*map(__import__("public_tokenizers").path, (T.BYTE_VOCABULARY, T.PIECE_VOCABULARY)))
    sizes, real = [], T.coalesced
    monkeypatch.setattr(T, "coalesced", lambda start, end, side: sizes.append(len(start)) or real(start, end, side))
    first = T.align_batch(e, ["the cat sat", "cat " * 1000, "a▁b", None])
    assert sum(sizes) < 40
    assert first["n_groups"].tolist()[2:] == [0, 0] and first["groups"][2:] == ["", ""]
    again = T.align_batch(e, ["the cat sat", "cat " * 1000])
    assert sum(sizes) < 80 and again["groups"] == first["groups"][:2] and again["n"].sum() == first["n"].sum()


def test_overlaps_and_groups():
    side = np.array([0, 0, 0, 1, 1, 1])
    start, end = np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 9, 3, 5, 9])
    order, group = T.coalesced(start, end, side)
    assert sorted(zip(group.tolist(), order.tolist())) == [(0, 0), (0, 1), (0, 3), (0, 4), (1, 2), (1, 5)]
    a, b = T.overlaps(start[:3], end[:3], start[3:], end[3:])
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2)]


def test_rows(spark):
    texts = [None, "", " ", "the cat", "the cat", "a▁b", "tail  ", "\n x", "word " * 20_000, "x" * 20_000]
    rows = [(k if k else None, t, "kept", 7) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, row int")
    with Workspace(spark) as ws:
        aligned = ws.save(T.align(docs, ["doc_id", "groups"]).withColumn("key", T.F.monotonically_increasing_id())).df
        for head in (1, 3, 10**6):  # rare pairs by shuffle, some, all by broadcast
            sums = T.scored_links(ws, aligned, "key", head)
            got = {r["doc_id"]: r for r in aligned.join(sums, "key", "left").collect()}
            for k, want in enumerate(expected(texts)):
                r = got[k if k else None]
                digest = hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else ""
                assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"] or 0, r["n_best"] or 0, r["count_sum"] or 0, digest) == want
        assert T.align(docs.limit(0), ["doc_id"]).count() == 0


def test_query_follows_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: w for d, w in zip(docs, expected([d["text"] for d in docs]))}
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert got == want

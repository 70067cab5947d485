"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matloom.llm import simhash, similar_texts
from matloom.llm.simhash import keep_one


def shingles(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_kept(texts, least=0.8):
    """The smallest id of each chain of similar texts."""
    sets, root = [shingles(t) for _, t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or both >= least * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    kept = {}
    for i, (doc, _) in enumerate(texts):
        kept[find(i)] = min(kept.get(find(i), doc), doc)
    return sorted(kept.values())


def planted():
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{int(i)}" for i in rng.integers(0, 3000, n)]
    texts, license_lines = [], word(60)
    for size in (5, 12, 40, 90, 150, 400):
        for _ in range(3):
            base = word(size)
            texts.append(base)
            for edits in (1, 2, 4, 8):
                changed = list(base)
                for at in rng.integers(0, size, edits):
                    changed[at] = "edited"
                texts.append(changed)
            texts += [base[1:], base[: -max(1, size // 8)], base + word(size // 5), [w.upper() for w in base]]
    texts += [license_lines + word(n) for n in (3, 5, 9, 14, 15, 16, 40, 60) for _ in range(4)]
    order = rng.permutation(len(texts)).tolist()
    rows = [(i, " ".join(texts[k])) for i, k in enumerate(order)]
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE two"), (905, "one two three")]


@pytest.mark.parametrize("sample", [(20_000, 3), (20_000, 10**9), (5, 1)])
def test_stage_keeps_one_of_all_within_the_similarity(spark, monkeypatch, sample):
    monkeypatch.setattr(similar_texts, "SAMPLE", sample[0])
    monkeypatch.setattr(similar_texts, "FREQUENT", sample[1])
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute_kept(rows)


def test_a_crowd_of_copies_forms_no_pairs(spark, monkeypatch):
    """Candidates stay in proportion to the texts, whatever the size of a crowd."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    formed = []
    for name in ("leader_pairs", "open_pairs"):
        real = getattr(similar_texts, name)

        def counted(*args, real=real):
            pairs = real(*args)
            formed.append(pairs.count())
            return pairs

        monkeypatch.setattr(similar_texts, name, counted)
    sizes = {}
    for crowd in (250, 1000):
        formed.clear()
        texts = []
        for i in range(crowd):
            copy = list(base)
            copy[rng.integers(0, 120)] = f"x{i}"
            texts.append((i, " ".join(copy)))
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
        kept = sorted(r["doc_id"] for r in keep_one(docs).collect())
        if crowd == 250:
            assert kept == brute_kept(texts)
        sizes[crowd] = sum(formed)
    assert sizes[1000] <= 6 * sizes[250] and sizes[1000] < 10_000


def test_clashing_columns_null_ids_and_equal_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "a", 1), (3, text, "b", 2), (3, text, "c", 3), (None, None, "d", 4), (4, "", "e", 5), (5, "other words", "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n int").withColumn("_row", F.lit(9)).withColumn("set", F.lit(1))
    out = keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(3, text), (4, ""), (5, "other words")]
    assert keep_one(docs.limit(0)).count() == 0


def test_the_stage_searches_fingerprints(spark, monkeypatch):
    """The groups of the SimHash search are compared before any other pair."""
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(i, base + f" end{i}") for i in range(6)] + [(9, "other words than these are here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    searched, compared, real, similar = [], [], simhash.group_prints, similar_texts._similar
    monkeypatch.setattr(simhash, "group_prints", lambda ws, prints: searched.append(prints.count()) or real(ws, prints))
    monkeypatch.setattr(similar_texts, "_similar", lambda pairs, *args: compared.append(pairs.rows) or similar(pairs, *args))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute_kept(rows)
    prints = {simhash.fingerprint(t.encode(), 5) for _, t in rows}
    assert searched == [len(prints)]
    assert compared[0] == 5

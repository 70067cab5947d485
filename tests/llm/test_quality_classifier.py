"""Quality classifier: its parts against plain versions, accuracy on texts never seen."""

import zlib

import numpy as np
import pytest
from conftest import SF

from matloom.llm import quality_classifier as Q
from matloom.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def test_indicators_of_blocks_are_those_of_the_whole(monkeypatch):
    text = " ".join(f"w{i % 97} x{i}" for i in range(3000)).encode()
    whole = Q.indicators(text)
    monkeypatch.setattr(Q, "BLOCK", 64)
    assert np.array_equal(Q.indicators(text), whole)
    assert len(Q.indicators(None)) == len(Q.indicators(b"")) == 0 and len(Q.indicators(b"ab")) == 1


def test_descent_reaches_the_least_loss():
    """No small move of the weights lowers the objective."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(60)]
    good = np.array([x.sum() + rng.integers(-12, 12) > 57 for x in rows])
    values = [np.full(6, 6**-0.5) for _ in rows]
    w, b = Q.dual_descent(rows, values, good, 20)
    limit = len(rows) / (2 * np.where(good, good.sum(), (~good).sum()))
    sign = np.where(good, 1, -1)

    def loss(w, b):
        hinge = [max(0, 1 - s * (w[x] @ v + b)) for s, x, v in zip(sign, rows, values)]
        return 0.5 * (w @ w + b * b) + limit @ hinge

    least = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(0, 0.05, 20), b + rng.normal(0, 0.05)) > least * 0.999


def test_sigmoid_fits_frequencies():
    rng = np.random.default_rng(2)
    m = rng.normal(0, 2, 20_000)
    a, b = Q.sigmoid_of(m, rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * m - 0.7))))
    assert abs(a - 1.5) < 0.1 and abs(b + 0.7) < 0.1


def held_out_scores(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op13_quality_classifier"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    out = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    y, s = map(np.array, zip(*out))
    return got, y, s


def test_held_out_accuracy(spark):
    got, y, s = held_out_scores(spark, LARGER)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert np.mean((s >= 0.3) == y) >= 0.94
    assert np.mean(s[y == 1][:, None] > s[y == 0][None]) >= 0.98


def test_every_row_is_scored_like_its_text(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = Q.learn(docs, labels)
    for r in Q.classify(docs, model, ["doc_id", "text"]).collect():
        assert r["score"] == pytest.approx(model.score(r["text"].encode()), abs=1e-12)


def test_rows(spark):
    rows = [(1, "good words here", "a"), (2, None, "b"), (3, "", None), (3, "", None), (None, "x" * 300_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = lambda *x: spark.createDataFrame(list(x), "doc_id long, quality int")
    both = Q.learn(docs, labels((1, 1), (3, 0), (3, 0), (None, 1), (2, None)))
    out = Q.classify(docs, both, ["doc_id", "score"])
    assert out.columns == ["doc_id", "score", "predicted"] and out.count() == 5
    assert Q.classify(docs.limit(0), both, ["doc_id"]).count() == 0
    # One class, contradicting labels, none at all: the smoothed share.
    for taught, share in (([(1, 1)], 2 / 3), ([(1, 1), (1, 0)], 1 / 2), ([], 1 / 2)):
        model = Q.learn(docs, labels(*taught))
        assert {round(r["score"], 9) for r in Q.classify(docs, model, ["doc_id"]).collect()} == {round(share, 9)}

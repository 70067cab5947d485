"""Quality classifier: a linear support vector machine on Naive Bayes features.

A text is the set of its n-grams: words, pairs of words (a word that repeats the
one before it is spelled as a mark), and sequences of three and four bytes, hashed
into buckets.  From labelled texts every bucket gets its
log-count ratio between the classes; a present bucket has that ratio as value,
and a text's values are scaled to length one.  A linear model with hinge loss is
fitted by dual coordinate descent, both classes weighing the same.  Margins of
labelled texts that the fit has not seen turn margins into probabilities.

The fit takes at most ``LABELLED`` labelled texts, those with the smallest hashes
of their ids; every text is scored, as a whole.

Defined results: a null text is empty, and an empty text is scored by the bias
alone; ids whose labels disagree, and labels without an id or a quality, teach
nothing; if one class is missing, every text gets the smoothed share of class 1;
repeated rows are scored one by one; an empty table gives an empty result; a kept
column with the name of a result column gives way to it, other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy as copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from matloom.llm.common import bound_batches, documents, slices
from matloom.llm.registry import query

BITS = 16
#: Most labelled texts of the fit, and how many of ten of them it uses; the
#: others calibrate.
LABELLED, FITTED = 8_000, 8
SMOOTHING, COST = 1.0, 1.0
EPOCHS, TOLERANCE, SEED = 40, 1e-2, 42
#: Least score of a text that is predicted to be of class 1.
THRESHOLD = 0.3
#: Stands for a word that repeats the word before it.
AGAIN = 1
#: Bytes of a text whose byte n-grams are hashed at a time.
BLOCK = 1 << 20
RESULT = ("score", "predicted")


# -- features -----------------------------------------------------------------


def indicators(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """The buckets of a text's n-grams, each once, rising."""
    import xxhash

    present = np.zeros(1 << bits, bool)
    text = text or b""
    data = np.frombuffer(text, np.uint8)
    for i in range(0, max(len(data) - 2, 0), BLOCK):
        part = data[i : i + BLOCK + 3].astype(np.uint32)
        three = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        present[_bucket(three, 1, bits)] = True
        present[_bucket(three[:-1] | part[3:] << np.uint32(24), 2, bits)] = True
    words = text.split()
    if words:
        codes = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))
        codes[1:][codes[1:] == codes[:-1]] = AGAIN
        present[_bucket(codes, 3, bits)] = True
        present[_bucket(codes[:-1] * np.uint32(0x85EBCA6B) ^ codes[1:], 4, bits)] = True
    return np.flatnonzero(present)


def _bucket(codes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Upper bits of a mixed product; every kind of n-gram mixes in another way."""
    x = (codes ^ np.uint32(kind * 0x27D4EB2F)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return (x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def with_indicators(docs: DataFrame, keep: list[str], bits: int = BITS) -> DataFrame:
    """Columns ``keep`` and the ``buckets`` of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [pa.array(indicators(t.as_py(), bits), pa.int32()) for t in batch.column("text").cast(pa.large_binary())]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([pa.array([], pa.int32()), *found]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "buckets"])

    bound_batches(docs)
    rows = docs.select(*keep, "text")
    return rows.mapInArrow(work, copy(rows.drop("text").schema).add("buckets", ArrayType(IntegerType())))


# -- model --------------------------------------------------------------------


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, buckets: int, smoothing: float = SMOOTHING) -> np.ndarray:
    counts = [np.full(buckets, smoothing), np.full(buckets, smoothing)]
    for x, y in zip(rows, good):
        counts[int(y)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, buckets: int, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss; ``rows`` hold the places of ``values``.

    Each step sets one text's multiplier to its best value within zero and the
    cost of its class; the bias is the weight of a value of one in every text.
    """
    w, bias, rng = np.zeros(buckets), 0.0, np.random.default_rng(SEED)
    sign = np.where(good, 1.0, -1.0)
    limit = cost * len(rows) / (2 * np.where(good, good.sum(), (~good).sum()))
    square = np.array([float(v @ v) for v in values]) + 1.0
    alpha = np.zeros(len(rows))
    for _ in range(EPOCHS):
        low, high = np.inf, -np.inf
        for k in rng.permutation(len(rows)):
            x, v = rows[k], values[k]
            slope = sign[k] * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[k] - slope / square[k], 0.0), limit[k])
            # The slope counts as far as it can still be followed.
            follow = slope if 0.0 < alpha[k] < limit[k] else min(slope, 0.0) if alpha[k] == 0.0 else max(slope, 0.0)
            low, high = min(low, follow), max(high, follow)
            if new != alpha[k]:
                step = (new - alpha[k]) * sign[k]
                w[x] += step * v
                bias += step
                alpha[k] = new
        if high - low < TOLERANCE:
            break
    return w, bias


def sigmoid_of(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """``(a, b)`` of the likeliest ``1 / (1 + exp(-(a * margin + b)))``.

    Targets are smoothed by class counts, and Newton steps are halved until they help.
    """
    n1, n0 = int(good.sum()), int((~good).sum())
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda p: float(np.sum(np.logaddexp(0, p[0] * margin + p[1]) - target * (p[0] * margin + p[1])))
    p = np.array([1.0, float(np.log((n1 + 1) / (n0 + 1)))])
    for _ in range(50):
        prob = 1 / (1 + np.exp(-np.clip(p[0] * margin + p[1], -500, 500)))
        g = np.array([np.sum((prob - target) * margin), np.sum(prob - target)])
        h = prob * (1 - prob)
        hess = np.array([[np.sum(h * margin**2), np.sum(h * margin)], [np.sum(h * margin), np.sum(h)]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, g)
        size = 1.0
        while size > 1e-6 and loss(p - size * step) > loss(p):
            size /= 2
        p = p - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    # A slope below zero would turn the order of the margins around.
    return max(float(p[0]), 1e-3), float(p[1])


@dataclass(frozen=True)
class Classifier:
    """``product`` is ratio times weight of each bucket, ``square`` the squared ratio."""

    product: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    @property
    def bits(self) -> int:
        return len(self.product).bit_length() - 1

    def margin(self, buckets: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[buckets].sum()))
        return float(self.product[buckets].sum()) / max(norm, 1e-12) + self.bias

    def score(self, text: bytes | None) -> float:
        x = self.slope * self.margin(indicators(text, self.bits)) + self.shift
        return 1 / (1 + float(np.exp(-min(max(x, -500.0), 500.0))))


def fit(rows: list[np.ndarray], good: np.ndarray, bits: int = BITS) -> Classifier:
    """A classifier from the buckets of labelled texts in a fixed order."""
    none = np.zeros(1 << bits)
    place = np.arange(len(rows))
    part = place % 10 < FITTED
    if min(good[part].sum(), (~good[part]).sum()) == 0:
        share = (good.sum() + 1) / (len(good) + 2)
        return Classifier(none, none, 0.0, 1.0, float(np.log(share / (1 - share))))
    chosen = [rows[k] for k in place[part]]
    ratio = log_count_ratio(chosen, good[part], 1 << bits)
    values = [ratio[x] / max(float(np.linalg.norm(ratio[x])), 1e-12) for x in chosen]
    w, bias = dual_descent(chosen, values, good[part], 1 << bits)
    model = Classifier(ratio * w, ratio**2, bias, 1.0, 0.0)
    rest = place[~part] if good[~part].any() and not good[~part].all() else place
    slope, shift = sigmoid_of(np.array([model.margin(rows[k]) for k in rest]), good[rest])
    return Classifier(model.product, model.square, bias, slope, shift)


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED, bits: int = BITS) -> Classifier:
    """Fit on at most ``most`` texts of ``docs`` that ``labels`` agree about."""
    agreed = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
    sample = agreed.where("_low = _high").select("_id", (F.col("_low") == 1).alias("_good")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    taught = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    # An id with several texts teaches by the first of them.
    taught = taught.groupBy("_id", "_good").agg(F.min("text").alias("text"))
    rows = with_indicators(taught, ["_id", "_good"], bits).orderBy(F.xxhash64("_id"), "_id").select("_good", "buckets").toArrow()
    good = rows.column("_good").to_numpy(zero_copy_only=False).astype(bool)
    lists = [x.values.to_numpy() for x in rows.column("buckets")]
    return fit(lists, good, bits)


def classify(docs: DataFrame, model: Classifier, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` of every row with its ``score`` and ``predicted`` class."""
    keep = [c for c in keep if c not in RESULT]
    free = "text"
    while free in keep:
        free += "_"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = np.array([model.score(t.as_py()) for t in batch.column(free).cast(pa.large_binary())])
            new = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, *RESULT])

    bound_batches(docs)
    rows = docs.select(*keep, F.col("text").alias(free))
    return rows.mapInArrow(work, copy(rows.drop(free).schema).add("score", DoubleType()).add("predicted", IntegerType()))


# -- query --------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """The fifth of all ids from which nothing is learned; a null id belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


@query("op13_quality_classifier")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    docs = documents(spark, sf_dir)
    model = learn(docs, labels)
    out = classify(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

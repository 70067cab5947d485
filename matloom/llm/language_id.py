"""Language identification by rank-order profiles of character n-grams.

Training counts every 1- to 3-gram of every training text per language and
keeps the most frequent as a ranked profile.  A document is ranked the same way
and goes to the language with the smallest out-of-place distance: the sum of
rank differences, with a fixed penalty for n-grams outside the profile.

Letters are lower-cased; everything else parts words, which are padded with one
blank on either side.  Characters beyond the basic plane share one symbol.
N-grams are counted for many documents at once by sorting packed codes.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
with no training text every document is ``und``; equal distances go to the
language that sorts first, equal counts to the smaller n-gram; rows of a null or
repeated doc_id are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy as copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matloom.llm.common import bound_batches, documents, in_blocks
from matloom.llm.registry import query

PROFILE = 300
#: Distinct languages that may be learned; each adds one profile to every task.
MAX_LANGUAGES = 1000
#: Characters ranked at a time.
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0
#: The pipeline rejects documents that fit even their best profile worse than this.
MIN_SCORE = 0.2

_BLANK, _ASTRAL = 0x20, 0xFFFF
_GRAM_BITS = 48


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Symbol of each basic-plane code point: itself for letters, else a blank."""
    table = np.full(0x10000, _BLANK, np.uint16)
    letters = [c for c in range(0x10000) if chr(c).isalpha()]
    table[letters] = letters
    return table


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    if codes.size and codes.max() >= 0x10000:
        high = np.unique(codes[codes >= 0x10000])
        letters = high[[chr(c).isalpha() for c in high]]
        codes = np.where(codes < 0x10000, codes, np.where(np.isin(codes, letters), _ASTRAL, _BLANK))
        table = _letters().copy()
        table[_ASTRAL] = _ASTRAL
        return table[codes]
    return _letters()[codes]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: (text number, packed n-gram, count)."""
    pieces = []
    for text in texts:
        s = _symbols(" " + text.lower() + " ")
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != _BLANK) | (s[:-1] != _BLANK)
        pieces.append(s[keep])
    symbols, ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    # Blocks of starts: what is held grows with the distinct n-grams, not with the text.
    for i in range(0, len(symbols), BLOCK_CHARS):
        found = _starts(symbols[i : i + BLOCK_CHARS + 2], i, ends)
        fresh, n = np.unique(found, return_counts=True)
        if len(keys):
            fresh, where = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            n = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
        keys, counts = fresh, n
    return (keys >> np.uint64(_GRAM_BITS)).astype(np.int64), (keys & np.uint64((1 << _GRAM_BITS) - 1)).astype(np.int64), counts


def _starts(part: np.ndarray, at: int, ends: np.ndarray) -> np.ndarray:
    """Packed (text, n-gram) of all n-grams that start at the first ``BLOCK_CHARS`` symbols.

    ``at`` is the place of the part in all symbols, ``ends`` where each text ends.
    """
    s, blank = part.astype(np.uint64), np.uint64(_BLANK)
    doc = np.searchsorted(ends, np.arange(at, at + len(s)), "right").astype(np.uint64) << np.uint64(_GRAM_BITS)
    one = (doc | s)[:BLOCK_CHARS][s[:BLOCK_CHARS] != blank]
    pair = (doc[:-1] == doc[1:]) & ((s[:-1] != blank) | (s[1:] != blank))
    two = (doc[:-1] | s[:-1] << np.uint64(16) | s[1:])[:BLOCK_CHARS][pair[:BLOCK_CHARS]]
    inside = (doc[:-2] == doc[2:]) & (s[1:-1] != blank)
    three = (doc[:-2] | s[:-2] << np.uint64(32) | s[1:-1] << np.uint64(16) | s[2:])[inside]
    return np.concatenate([one, two, three])


def learn(training: DataFrame, profile: int = PROFILE, max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Ranked n-grams per language from ``(text, lang)``, over all its rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, size=BLOCK_CHARS):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            doc, gram, n = _grams(batch.column("text").to_pylist())
            # Sum over the documents of a block before anything is sent.
            key, where = np.unique(number[doc] << _GRAM_BITS | gram, return_inverse=True)
            total = np.bincount(where, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(names, object)[key >> _GRAM_BITS]), pa.array(key & ((1 << _GRAM_BITS) - 1)), pa.array(total)],
                ["lang", "gram", "n"],
            )

    bound_batches(training)
    labelled = training.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", best).where(F.col("rank") <= profile).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("grams"))
    rows = top.limit(max_languages + 1).collect()
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages in the training rows")
    return {r["lang"]: np.array([g["gram"] for g in r["grams"]], np.int64) for r in sorted(rows, key=lambda r: r["lang"])}


def _judge(texts: list[str], names: list[str], known: np.ndarray, ranks: np.ndarray, profile: int) -> tuple[np.ndarray, np.ndarray]:
    """Best language number (or -1) and score of each text.

    ``known`` are all profile n-grams, sorted; ``ranks`` their rank per language
    (``profile`` where absent).
    """
    doc, gram, n = _grams(texts)
    order = np.lexsort((gram, -n, doc))
    doc, gram = doc[order], gram[order]
    starts = np.searchsorted(doc, np.arange(len(texts)))
    place = np.arange(len(doc)) - starts[doc] if len(doc) else doc
    doc, gram, place = doc[place < profile], gram[place < profile], place[place < profile]
    size = np.bincount(doc, minlength=len(texts))
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    absent = known[at] != gram
    distance = np.empty((len(names), len(texts)))
    for k in range(len(names)):
        theirs = ranks[k][at]
        out = np.where(absent | (theirs == profile), profile, np.abs(theirs - place))
        distance[k] = np.bincount(doc, out, minlength=len(texts))
    best = np.argmin(distance, axis=0)
    worst = np.maximum(size * profile, 1)
    score = 1 - distance[best, np.arange(len(texts))] / worst
    return np.where(size > 0, best, -1), np.where(size > 0, score, 0.0)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], profile: int = PROFILE, named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of every row, its text's language and score, as ``named``."""
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[x] for x in names])) if names else np.empty(0, np.int64)
    ranks = np.full((len(names), len(known)), profile, np.int64)
    for k, x in enumerate(names):
        ranks[k, np.searchsorted(known, profiles[x])] = np.arange(len(profiles[x]))
    judged = [c for c in keep if c not in (*named, "_text")]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, text="_text", size=BLOCK_CHARS):
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            if len(known):
                best, score = _judge(texts, names, known, ranks, profile)
            else:
                best, score = np.full(len(texts), -1), np.zeros(len(texts))
            langs = pa.array([names[b] if b >= 0 else UNKNOWN for b in best])
            columns = [batch.column(c) for c in judged]
            yield pa.RecordBatch.from_arrays([*columns, langs, pa.array(score)], [*judged, *named])

    bound_batches(docs)
    rows = docs.select(*judged, F.col("text").alias("_text"))
    return rows.mapInArrow(tag, copy(rows.drop("_text").schema).add(named[0], "string").add(named[1], "double"))


def held_out() -> Column:
    """The fold of a document, from its id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn on the training folds of ``docs`` and judge every row."""
    profiles = learn(docs.where(~held_out()))
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out())
    return predict(rows, profiles, ["doc_id", "held_out"])


def reject_unknown(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents whose language is known, with their own columns."""
    profiles = learn(docs.where(~held_out()))
    judged = predict(docs, profiles, docs.columns, named=("_lang", "_score"))
    return judged.where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= min_score)).select(*docs.columns)


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))

"""Alignment of the tokens of two vocabularies over the same bytes.

Both vocabularies cut the same text, so their tokens are intervals of one byte
axis.  All intervals of a batch of chunks are sorted by their start; a running
maximum of their ends tells where a start reaches all ends before it, and there
a group breaks.  Within groups the overlapping pairs of tokens are expanded; a
pair whose ends agree is a link.  How often a pair of ids is linked in the whole
corpus, and the best partner of an id, are grouped sums over all texts.

Counts are looked up in two ways that together hold every pair: pairs with at
least ``1/HEAD`` of all links, of which there can be no more than ``HEAD``, are
broadcast; all others are joined by a shuffle in which no key is frequent.

A text is tokenised by its space-separated chunks, which either vocabulary cuts
from each other anyway.  No group or link crosses such a cut, so chunks are also
aligned one by one, and a text strings together the groups and links of its chunks.
Chunks met before are looked up in a bounded memory, which changes speed and never
results.

Defined results: null and empty texts, and texts that one of the vocabularies
does not give back byte for byte, have no tokens, no links and empty groups;
repeated rows are aligned one by one and all count; an empty table gives an empty
result; a kept column with the name of a result column gives way to it, other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy as copy
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from matloom.llm.common import bound_batches, documents, in_blocks, slices
from matloom.llm.registry import query
from matloom.llm.tokens import printable_bytes
from matloom.runtime import Workspace

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how the piece vocabulary spells a space.
SPACE = "▁"
#: Chunks a worker remembers, and the longest of them.
KNOWN_CHUNKS, CHUNK_CHARS = 200_000, 64
#: At most so many pairs of ids have more than this part of all links.
HEAD = 100_000

#: Numbers of tokens of both sides and of groups, the groups, and the links as 64-bit
#: integers ``a << 17 | b``.
Chunk = tuple[int, int, int, str, bytes]
LINK = StructType().add("a", IntegerType()).add("b", IntegerType()).add("n", IntegerType())
RESULT = ("n_a", "n_b", "n_groups", "groups", "links")


# -- tokens -------------------------------------------------------------------


class PairEncoder:
    """Token ids of a text, after one space, in both vocabularies."""

    def __init__(self, byte_path: str, piece_path: str, capacity: int = KNOWN_CHUNKS):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        spelled = printable_bytes()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(spelled[c] for c in t) if set(t) <= spelled.keys() else b"" for t in tokens]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        # A piece that went on behind a space inside would join two chunks.
        if any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.b.get_piece_size())):
            raise ValueError("the piece vocabulary joins words")
        self.capacity = capacity
        self.known: dict[str, Chunk | None] = {}
        self.aged: dict[str, Chunk | None] = {}

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        return self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def encode(self, text: str | None) -> tuple[bytes, bytes] | None:
        """Little-endian 32-bit ids of both vocabularies; None without tokens."""
        chunks = self.aligned([text])[0]
        if not chunks:
            return None
        sides = zip(*(g.split("|") for c in chunks for g in c[3].split(";")))
        a, b = (np.array([int(i) for ids in side for i in ids.split(",")], "<u4").tobytes() for side in sides)
        return a, b

    def aligned(self, texts: list[str | None]) -> list[list[Chunk]]:
        """The aligned chunks of each text; none of a text without tokens."""
        parts = [_chunks(t) if t else [] for t in texts]
        found = {c: self.known.get(c) for c in set(chain.from_iterable(parts))}
        found.update(self._learn([c for c, x in found.items() if x is None]))
        out = [list(map(found.__getitem__, chunks)) for chunks in parts]
        return [[] if None in chunks else chunks for chunks in out] if None in found.values() else out

    def _spell(self, sides: list[tuple[list[int], list[int]]], whole: list[bytes]) -> bool:
        """Whether the tokens of both sides of every chunk give back its bytes."""
        text, cuts = b"".join(whole), np.cumsum([len(w) for w in whole])
        for k, (spelled, length) in enumerate(((self.a_bytes, self.a_length), (self.b_bytes, self.b_length))):
            ids = list(chain.from_iterable(x[k] for x in sides))
            if b"".join(map(spelled.__getitem__, ids)) != text:
                return False
            # Behind equal bytes, equal ends of the chunks make each equal.
            ends = np.append(0, np.cumsum(length[np.array(ids, np.int64)]))
            if (ends[np.cumsum([len(x[k]) for x in sides])] != cuts).any():
                return False
        return True

    def _learn(self, chunks: list[str]) -> dict[str, Chunk | None]:
        new = {c: self.aged[c] for c in chunks if c in self.aged}
        need = [c for c in chunks if c not in new]
        if need:
            coded = self.a.encode_batch_fast([" " + c for c in need], add_special_tokens=False)
            sides = [(x.ids, b) for x, b in zip(coded, self.b.encode(need, num_threads=1))]
            whole = [b" " + c.encode() for c in need]
            if not self._spell(sides, whole):
                sides = [x if self._spell([x], [w]) else ([], []) for x, w in zip(sides, whole)]
            new.update((c, x if x[0] else None) for c, x in zip(need, align_ids(self, sides)))
        short = {c: x for c, x in new.items() if x and len(c) <= CHUNK_CHARS}
        if len(self.known) + len(short) > self.capacity:
            self.aged, self.known = self.known, {}
        self.known.update(short)
        return new


def _chunks(text: str) -> list[str]:
    """Chunks with one space before each, which make up the text with its own.

    Both vocabularies cut before a space behind a character that is no white
    space; other spaces stay inside a chunk.
    """
    parts = text.split(" ")
    if not any(not e or e.isspace() for e in {p[-1:] for p in parts}):
        return parts
    chunks = parts[:1]
    for p in parts[1:]:
        if p and chunks[-1] and not chunks[-1][-1].isspace():
            chunks.append(p)
        else:
            chunks[-1] += " " + p
    return chunks


@lru_cache(maxsize=2)
def pair_encoder(byte_path: str | None = None, piece_path: str | None = None) -> PairEncoder:
    """One per Python worker; the paths default to the public vocabulary files."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if byte_path is None or piece_path is None:
        import public_tokenizers

        byte_path = byte_path or public_tokenizers.path(BYTE_VOCABULARY)
        piece_path = piece_path or public_tokenizers.path(PIECE_VOCABULARY)
    return PairEncoder(byte_path, piece_path)


# -- intervals ----------------------------------------------------------------


def coalesced(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, group)``: intervals by start, and the group of each of these."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(fresh) - 1


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs ``(a, b)`` of overlapping intervals, each side sorted and disjoint."""
    first = np.searchsorted(a_end, b_start, "right")
    count = np.searchsorted(a_start, b_end, "left") - first
    b = np.repeat(np.arange(len(b_start)), count)
    a = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count) + first[b]
    return a, b


@lru_cache(maxsize=2)
def _spelled(ids: int) -> list[str]:
    """An id and what follows it: another of its side, the other side, the next
    group, nothing."""
    return [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(ids)]


def align_ids(encoder: PairEncoder, coded: list[tuple[list[int], list[int]]]) -> list[Chunk]:
    """What ``Chunk`` holds of the ids of both sides of each chunk."""
    ids, ends, owner = [], [], []
    for k, length in enumerate((encoder.a_length, encoder.b_length)):
        ids.append(np.fromiter(chain.from_iterable(c[k] for c in coded), np.int64))
        owner.append(np.repeat(np.arange(len(coded)), [len(c[k]) for c in coded]))
        # The chunks follow each other on one axis, which both sides cover.
        ends.append(np.cumsum(length[ids[k]]))
    starts = [np.append(0, e)[:-1] for e in ends]
    side = np.repeat([0, 1], [len(x) for x in ids])
    order, group = coalesced(np.concatenate(starts), np.concatenate(ends), side)
    by = np.argsort(2 * group + side[order], kind="stable")
    order, group = order[by], group[by]
    side, chunk, every = side[order], np.concatenate(owner)[order], np.concatenate(ids)[order]
    mark = np.full(len(order), 3)
    mark[:-1] = np.select([chunk[1:] != chunk[:-1], group[1:] != group[:-1], side[1:] != side[:-1]], [3, 2, 1], 0)
    most = max(len(encoder.a_length), len(encoder.b_length))
    spell, cut = _spelled(most).__getitem__, np.searchsorted(chunk, np.arange(len(coded) + 1)).tolist()
    shown = (mark * most + every).tolist()
    pairs = overlaps(starts[0], ends[0], starts[1], ends[1])
    linked = ends[0][pairs[0]] == ends[1][pairs[1]]
    a, b = pairs[0][linked], pairs[1][linked]
    links = ((ids[0][a] << 17) | ids[1][b]).tobytes()
    link_cut = (8 * np.searchsorted(owner[0][a], np.arange(len(coded) + 1))).tolist()
    groups = np.bincount(chunk, np.append(np.diff(group), 1) if len(group) else None, minlength=len(coded)).astype(np.int64).tolist()
    return [
        (len(x), len(y), n, "".join(map(spell, shown[i:j])), links[p:q])
        for (x, y), n, i, j, p, q in zip(coded, groups, cut, cut[1:], link_cut, link_cut[1:])
    ]


def align_batch(encoder: PairEncoder, texts: list[str | None]) -> dict[str, np.ndarray | list]:
    """Numbers, groups and links of each text; see ``align``."""
    chunks = encoder.aligned(texts)
    columns = [tuple(zip(*c)) or ((),) * 5 for c in chunks]
    links = [b"".join(c[4]) for c in columns]
    owner = np.repeat(np.arange(len(texts)), [len(x) // 8 for x in links])
    key, n = np.unique((owner << 34) | np.frombuffer(b"".join(links), np.int64), return_counts=True)
    return {
        **{name: np.array([sum(c[k]) for c in columns], np.int64) for k, name in enumerate(RESULT[:3])},
        "groups": [";".join(c[3]) for c in columns],
        "link_cut": np.searchsorted(key >> 34, np.arange(len(texts) + 1)),
        "a": (key >> 17) & 0x1FFFF,
        "b": key & 0x1FFFF,
        "n": n,
    }


def align(docs: DataFrame, keep: list[str], byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Columns ``keep`` of every row with the numbers of tokens and groups, the
    ``groups`` as ``a1,a2|b1;a3|b2,b3``, and the distinct linked pairs of ids
    ``(a, b)`` with the number ``n`` of their links in the text."""
    keep = [c for c in keep if c not in RESULT]
    free = "text"
    while free in keep:
        free += "_"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_encoder(byte_path, piece_path)
        for batch in in_blocks(slices(batches, 1024), free):
            out = align_batch(encoder, batch.column(free).to_pylist())
            links = pa.StructArray.from_arrays([pa.array(out[c].astype(np.int32)) for c in "abn"], list("abn"))
            new = [
                *[pa.array(out[c].astype(np.int64)) for c in RESULT[:3]],
                pa.array(out["groups"], pa.string()),
                pa.ListArray.from_arrays(pa.array(out["link_cut"].astype(np.int32)), links),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, *RESULT])

    bound_batches(docs)
    rows = docs.select(*keep, F.col("text").alias(free))
    schema = copy(rows.drop(free).schema)
    for c in RESULT[:3]:
        schema.add(c, LongType())
    return rows.mapInArrow(work, schema.add("groups", StringType()).add("links", ArrayType(LINK)))


# -- corpus counts ------------------------------------------------------------


def pair_counts(ws: Workspace, links: DataFrame):
    """``(a, b, count, best)`` of exploded ``links``; ``best`` is the highest
    count of any pair with the same ``b``."""
    counts = ws.save(links.groupBy("a", "b").agg(F.sum("n").alias("count")), total=F.sum("count"))
    best = counts.df.groupBy("b").agg(F.max("count").alias("best"))
    return ws.save(counts.df.join(best, "b").select("a", "b", "count", "best")), counts.stats["total"] or 0


def scored_links(ws: Workspace, aligned: DataFrame, key: str, head: int = HEAD) -> DataFrame:
    """``(key, n_links, n_best, count_sum)`` of every row that has links.

    ``aligned`` is a written table with ``key`` and ``links``.
    """
    links = aligned.select(key, F.explode("links").alias("l")).select(key, "l.*")
    counts, total = pair_counts(ws, links)
    often = F.col("count") * head >= total
    frequent = F.broadcast(counts.df.where(often))
    met = links.join(frequent, ["a", "b"])
    rare = links.join(frequent.select("a", "b"), ["a", "b"], "left_anti").join(counts.df.where(~often), ["a", "b"])

    def sums(df: DataFrame) -> DataFrame:
        best = F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)
        return df.groupBy(key).agg(F.sum("n").alias("n_links"), F.sum(best).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))

    both = sums(met).unionByName(sums(rare))
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, file_factor=1)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = align(documents(spark, sf_dir), ["doc_id"]).withColumn("groups_sha256", digest).drop("groups")
    aligned = ws.save(aligned.withColumn("row", F.monotonically_increasing_id())).df
    sums = scored_links(ws, aligned, "row")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"
    )

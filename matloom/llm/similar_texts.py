"""Groups of texts by the exact Jaccard similarity of their word shingles.

A text is its set of shingles.  Two sets of similarity ``least`` share a shingle
among the first ``n - ceil(least * n) + 1`` of each, whatever the order of all
shingles, so a join on these finds every pair.  The order puts shingles last that
are frequent in a sample of the texts, which keeps most passages of many texts
out of the join; it decides the number of candidates and never a result.

Only groups are wanted, so pairs are not formed first.  A search over fingerprints
comes before all else: of the sets that it puts into one group, each is compared, on
whole sets, with the first.  The rest is what makes the answer exact, as a radius of
bits promises no similarity.  Each shingle of the join has a leader, and each set is
compared with the one leader that it has most shingles in common with, unless lengths
or places rule the similarity out.  Sets are moved for a comparison only if their
sketches, the parities of their shingles in a table of bits, differ in no more bits
than similar sets can differ in shingles.  Further rounds, with other leaders, go over the
shingles that still lie in several groups.  What is left, sets of different groups
with a shingle in common, is then compared pair by pair, so no link is lost; most of a
crowd of near copies is one group by then and forms no pairs.

Shingles are told apart by 64-bit hashes, sets by 128 bits, rows by their id and
a 128-bit digest of their text.

Defined results: a text of fewer words than a shingle is one shingle of all its
words; null texts and texts without words are equal sets; case is folded for A-Z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy as copy
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from matloom.llm.common import bound_batches, slices
from matloom.model import Graph
from matloom.operators.graph import components
from matloom.runtime import BROADCAST_BYTES, CELL_BYTES, Saved, Workspace

SHINGLE, LEAST = 5, 0.8
#: Texts of the sample, texts of it from which a shingle is frequent, and shingles that are listed.
SAMPLE, FREQUENT, LISTED = 20_000, 3, 200_000
SEED = 42
#: 64-bit words of the sketch that goes with every key of the exact comparison; a power of two.
WORDS = 8
#: Rounds of leaders before the exact comparison.
LEADERS = 4
#: Bytes of a row of an id and a digest when it is sent to every task.
IDENTITY_BYTES = 100
_EPS = 1e-9


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    return np.unique(out ^ (out >> np.uint64(32)))


def prefix(s: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which similar sets share one, rarest first."""
    values, counts = frequent
    rank = np.zeros(len(s), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        rank = np.where(values[at] == s, counts[at], 0)
    n = len(s) - int(np.ceil(least * len(s) - _EPS)) + 1 if len(s) else 0
    return s[np.lexsort((s, rank))][:n]


def sketch(s: np.ndarray) -> bytes:
    """The parity of the number of shingles at each of a power of two of bits.

    A shingle of one of two sets changes one bit, so the sketches of sets differ in
    at most as many bits as the sets in shingles.
    """
    bits = max(64, 1 << int(len(s) - 1).bit_length())
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def short_sketch(s: np.ndarray) -> np.ndarray:
    """A sketch of ``WORDS`` words for sets of any size; it tells short texts apart."""
    at = (s & np.uint64(64 * WORDS - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * WORDS) & 1, bitorder="little").view("<u8")


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the longer folded to the length of the other."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _sets(docs: DataFrame, keep: list[str], size: int) -> DataFrame:
    """Columns ``keep`` and the whole ``shingles`` of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = batch.column("text").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _lists([shingle_set(t.as_py(), size) for t in texts])], [*keep, "shingles"])

    bound_batches(docs)
    rows = docs.select(*keep, "text")
    return rows.mapInArrow(work, copy(rows.drop("text").schema).add("shingles", ArrayType(LongType())))


def _frequent(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles most frequent in a sample, sorted, and their counts."""
    every = max(1, rows.count() // SAMPLE)
    texts = rows.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
    counts = _sets(texts, [], size).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(LISTED).toPandas()
    values, n = listed["s"].to_numpy(np.int64).view(np.uint64), listed["n"].to_numpy(np.int64)
    order = np.argsort(values)
    return values[order], n[order]


def digest(text: Column) -> Column:
    """128 bits of a text; null for null."""
    return F.md5(text)


def _prefixes(rows: DataFrame, size: int, least: float, frequent: tuple[np.ndarray, np.ndarray], mark: Callable[[bytes | None, int], int]) -> DataFrame:
    """``(doc_id, digest, set, n, prefix, fp, sketch, words)`` of ``(doc_id, digest, text)``;
    ``mark`` makes the fingerprint of a text."""
    names = ["doc_id", "digest"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 64):
            texts = batch.column("text").cast(pa.large_binary())
            found = [shingle_set(t.as_py(), size) for t in texts]
            prints = np.fromiter((mark(t.as_py(), size) for t in texts), "<u8", batch.num_rows).view("<i8")
            ids = pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in found], pa.binary())
            columns = [ids, pa.array([len(s) for s in found], pa.int64()), _lists([prefix(s, least, frequent) for s in found]), pa.array(prints)]
            columns.append(pa.array([sketch(s) for s in found], pa.binary()))
            columns.append(_lists([short_sketch(s) for s in found]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "set", "n", "prefix", "fp", "sketch", "words"])

    bound_batches(rows)
    schema = copy(rows.drop("text").schema).add("set", "binary").add("n", "long").add("prefix", ArrayType(LongType())).add("fp", "long").add("sketch", "binary").add("words", ArrayType(LongType()))
    return rows.mapInArrow(work, schema)


def small_side(ids: Saved) -> DataFrame:
    """Broadcast where its counted rows allow it, else left to a shuffle."""
    return F.broadcast(ids.df) if ids.rows * IDENTITY_BYTES <= BROADCAST_BYTES else ids.df


def shared_keys(ws: Workspace, firsts: DataFrame) -> DataFrame:
    """``(key, set, n, i, share)``: shingles that several sets have in their prefix,
    with the place ``i`` of the shingle in the order of its set and the share, in
    eighths, of the prefix of the set that others have as well."""
    # Few keys are shared: lengths are looked up for those alone.
    keys = firsts.select("set", F.posexplode("prefix").alias("i", "key"))
    # One shuffle of all keys counts them and hands on those that stay.
    sets = F.count(F.lit(1)).over(Window.partitionBy("key"))
    live = ws.save(keys.withColumn("sets", sets).where("sets > 1").drop("sets")).df
    share = live.groupBy("set").agg(F.count(F.lit(1)).alias("c")).join(firsts.select("set", "n", F.size("prefix").alias("p")), "set")
    share = ws.save(share.select("set", "n", F.round(8 * F.col("c") / F.col("p")).cast("int").alias("share"))).df
    return ws.save(live.join(share, "set").select("key", "set", "n", "i", "share")).df


def _may_be_similar(least: float) -> Column:
    """Whether two sets whose first common shingle has places i_a and i_b can be.

    Behind that shingle they share at most the rest of the shorter remainder.
    Every similar pair meets in its first common shingle, so it is enough that
    the condition holds there.
    """
    most = 1 + F.least(F.expr("n_a - i_a - 1"), F.expr("n_b - i_b - 1"))
    return most >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - _EPS


def first_of_lists(keys: DataFrame) -> DataFrame:
    """The rows of one key, the first, of all that the same sets have.

    The first common key of two sets is the first of its list, so they still meet there.
    """
    marks = [F.bit_xor(F.xxhash64("set", F.lit(seed))).alias(f"mark_{seed}") for seed in (0, 1)]
    lists = keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), *marks, F.min(F.struct("set", "i")).alias("least"))
    # The sets agree in the order of their keys: the places in one of them tell the first.
    chosen = lists.groupBy("sets", "mark_0", "mark_1", "least.set").agg(F.min(F.struct("least.i", "key")).alias("first"))
    return keys.join(chosen.select("first.key"), "key")


def print_pairs(leading: DataFrame, near: DataFrame) -> DataFrame:
    """``(a, b, lead)``: each ``(set, fp)`` with the first set of its group ``(fp, group)``."""
    members = leading.join(near, "fp").select("set", "group")
    lead = members.groupBy("group").agg(F.min("set").alias("lead"))
    return members.join(lead, "group").where("set <> lead").select(F.col("lead").alias("a"), F.col("set").alias("b"), "lead")


def leader_pairs(keys: DataFrame, least: float, turn: int, tested: DataFrame | None = None) -> DataFrame:
    """``(a, b, lead)``: each set with one leader of its keys that is of another group,
    the one it has most keys in common with; at most one pair per set.

    The leader of a key is one of the sets that have most in common with others,
    which in a crowd of copies are those next to its origin; every turn draws
    another one.
    """
    member = F.struct("share", F.xxhash64("set", F.lit(turn)).alias("draw"), *[F.col(c) for c in ("set", "n", "i", "group")])
    lead = keys.groupBy("key").agg(F.max(member).alias("l"))
    met = keys.join(lead, "key").where(F.col("group") != F.col("l.group"))
    met = met.select(
        "set", F.col("l.set").alias("lead"),
        F.col("n").alias("n_a"), F.col("l.n").alias("n_b"), F.col("i").alias("i_a"), F.col("l.i").alias("i_b"),
    ).where(_may_be_similar(least))
    # Common keys weigh against the lengths: a long set has more of them by chance.
    common = met.groupBy("set", "lead").agg((F.count(F.lit(1)) / (F.max("n_a") + F.max("n_b"))).alias("c"))
    common = common.select("set", "lead", "c", F.least("set", "lead").alias("a"), F.greatest("set", "lead").alias("b"))
    if tested is not None:
        common = common.join(tested, ["a", "b"], "left_anti")
    best = common.groupBy("set").agg(F.max(F.struct("c", "a", "b", "lead")).alias("m"))
    return best.groupBy("m.a", "m.b").agg(F.max("m.lead").alias("lead"))


def open_pairs(keys: DataFrame, least: float, sketches: DataFrame) -> DataFrame:
    """``(a, b, lead)``: all pairs of sets of different groups that may be similar;
    ``sketches`` has ``(set, words)``."""
    keys = first_of_lists(keys).join(sketches.select("set", "words"), "set")
    a, b = (keys.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("set", "n", "i", "group", "words")]) for x in "ab")
    bits = reduce(Column.__add__, [F.bit_count(F.col("words_a")[k].bitwiseXOR(F.col("words_b")[k])) for k in range(WORDS)])
    near = bits <= (1 - least) / (1 + least) * (F.col("n_a") + F.col("n_b")) + 1e-6
    apart = (F.col("group_a") < F.col("group_b")) & _may_be_similar(least) & near
    met = a.join(b, "key").where(apart)
    met = met.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct()
    return met.withColumn("lead", F.col("b"))


def _sketched(pairs: Saved, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b, lead)`` whose sketches do not rule the similarity out.

    ``sketches`` has ``(set, n, sketch)``; only those of pairs are moved.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = (batch.column(c).to_pylist() for c in ("x", "y", "n"))
            most = (1 - least) / (1 + least) * np.array(n, float) + 1e-6
            near = np.array([apart(*xy) for xy in zip(x, y)], float) <= most
            yield batch.select(["a", "b", "lead"]).filter(pa.array(near))

    short = small_side(pairs)
    left = sketches.select(F.col("set").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x")).join(short, "a")
    right = sketches.select(F.col("set").alias("b"), "n", F.col("sketch").alias("y"))
    right = right.join(small_side(Saved(pairs.df.select("b"), pairs.path, pairs.stats)), "b", "left_semi")
    both = left.join(right, "b").select("a", "b", "lead", "x", "y", (F.col("m") + F.col("n")).alias("n"))
    bound_batches(both)
    return both.mapInArrow(work, copy(both.select("a", "b", "lead").schema))


def _similar(pairs: Saved, sets: DataFrame, least: float) -> DataFrame:
    """The ``(a, b)`` whose whole sets are similar.

    Only sets of a pair are moved, and those of leaders, which are few, once each.
    """
    own = F.when(F.col("a") == F.col("lead"), F.col("b")).otherwise(F.col("a"))
    short = (lambda df: F.broadcast(df)) if pairs.rows * IDENTITY_BYTES <= BROADCAST_BYTES else (lambda df: df)
    left = sets.select(F.col("set").alias("own"), F.col("shingles").alias("x")).join(short(pairs.df.withColumn("own", own)), "own")
    right = sets.select(F.col("set").alias("lead"), F.col("shingles").alias("y"))
    right = right.join(short(pairs.df.select("lead").distinct()), "lead", "left_semi")
    shared = F.size(F.array_intersect("x", "y"))
    both = left.join(right, "lead").select("a", "b", shared.alias("c"), (F.size("x") + F.size("y")).alias("n"))
    return both.where(F.col("c") >= least * (F.col("n") - F.col("c")) - _EPS).select("a", "b")


def _grouped(ws: Workspace, links: DataFrame) -> DataFrame:
    edges = ws.save(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).df
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ws.save(components(ws, Graph(edges, ends)).select(F.col("id").alias("set"), F.col("comp").alias("group"))).df


def _still_mixed(keys: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Keys of several groups, with the group of each set."""
    named = keys.withColumn("group", F.col("set"))
    if groups is not None:
        named = keys.join(groups, "set", "left").withColumn("group", F.coalesce("group", "set"))
    mixed = named.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    return named.join(mixed.select("key"), "key").select("key", "set", "n", "i", "share", "group")


def similar_groups(
    ws: Workspace, docs: DataFrame, mark: Callable[[bytes | None, int], int],
    near: Callable[[Workspace, DataFrame], DataFrame], shingle: int = SHINGLE, least: float = LEAST,
) -> DataFrame:
    """``(doc_id, digest, group)`` of every row.

    Rows are in one group if a chain of similar pairs leads from one to the other.
    ``mark`` makes the fingerprint of a text from shingles of a size, and ``near``
    finds ``(fp, group)`` of near ones among distinct ``fp``.
    """
    texts = docs.select("doc_id", digest(F.col("text")).alias("digest"), "text")
    prefixes = _prefixes(texts, shingle, least, _frequent(texts, shingle), mark)
    rows = ws.save(prefixes.withColumn("row", F.monotonically_increasing_id())).df
    # Equal sets are searched once, under the number of their first row.
    firsts = ws.save(rows.groupBy("set").agg(F.min("row").alias("first"))).df
    plain = rows.select("doc_id", "digest", "set").join(firsts, "set").select("doc_id", "digest", F.col("first").alias("set"))
    # Most sets are of one row: the few rows that repeat one are left out, without moving the rest.
    later = ws.save(rows.select("row", "set").join(firsts, "set").where("row <> first").select("row"), rows=F.count(F.lit(1)))
    leading = rows.where("n > 0").join(F.broadcast(later.df) if later.rows * CELL_BYTES <= BROADCAST_BYTES else later.df, "row", "left_anti")
    keys = shared_keys(ws, leading.select(F.col("row").alias("set"), "n", "prefix"))
    marked = ws.save(leading.select(F.col("row").alias("set"), "n", "fp", "sketch", "words")).df
    by_print = print_pairs(marked, near(ws, ws.save(marked.select("fp").distinct()).df))
    repeated = not rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()

    def whole(ids: DataFrame) -> DataFrame:
        """The whole sets of ``set`` numbers."""
        ends = rows.join(ids.withColumnRenamed("set", "row"), "row").select("row", "doc_id", "digest")
        ends = small_side(ws.save(ends, rows=F.count(F.lit(1))))
        same = texts.doc_id.eqNullSafe(ends.doc_id) & texts.digest.eqNullSafe(ends.digest)
        found = texts.join(ends, same).select(ends.row.alias("set"), texts.text)
        made = _sets(found, ["set"], shingle)
        return made.dropDuplicates(["set"]) if repeated else made

    mixed, groups, links, tested, sets = ws.save(_still_mixed(keys, None)), None, [], None, None
    for turn in range(-1, LEADERS + 1):
        final = turn == LEADERS
        if turn < 0:
            pairs = by_print
        else:
            pairs = open_pairs(mixed.df, least, marked) if final else leader_pairs(mixed.df, least, turn, tested)
        if final and tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = ws.save(pairs, rows=F.count(F.lit(1)))
        if not pairs.rows:
            continue
        compared = pairs.df.select("a", "b")
        tested = compared if tested is None else tested.unionAll(compared)
        pairs = ws.save(_sketched(pairs, marked, least), rows=F.count(F.lit(1)))
        if not pairs.rows:
            continue
        ends = pairs.df.select(F.col("a").alias("set")).union(pairs.df.select("b")).distinct()
        more = ws.save(whole(ends if sets is None else ends.join(sets, "set", "left_anti"))).df
        sets = more if sets is None else sets.unionAll(more)
        found = ws.save(_similar(pairs, sets, least), rows=F.count(F.lit(1)))
        if found.rows:
            links.append(found.df)
            groups = _grouped(ws, reduce(DataFrame.unionAll, links))
            if not final:
                mixed = ws.save(_still_mixed(mixed.df.drop("group"), groups))
    if groups is None:
        return plain.withColumnRenamed("set", "group")
    return plain.join(groups, "set", "left").select("doc_id", "digest", F.coalesce("group", "set").alias("group"))

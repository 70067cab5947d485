"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits, each with a table from its value to
the fingerprints that have it.  Fingerprints that differ in at most two bits
differ in at most one within some segment, so each looks up the Hamming ball of
radius one of its segment values, and what the tables return is verified on all
64 bits.  Of two values one bit apart only the one without that bit probes.

A value that many fingerprints share, as those of a crowd of near copies, is not
searched as one list: its entries are indexed again by the two quarters of the
other half, with a ball of the bits that are still allowed to differ.  Where 48
common bits still hold too many, the ball of the last 16 is enumerated and whole
fingerprints are looked up.  Every list that is read is therefore short, and no
pair is lost at any level.

Only distinct fingerprints are searched; copies join their group afterwards.

Defined results: a null text, or one without words, has fingerprint zero, which
links like any other; repeated rows are single members with equal fingerprints;
a null doc_id never names a component unless all its members are null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy as copy
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.llm import similar_texts
from matloom.llm.common import bound_batches, documents, slices
from matloom.llm.registry import query
from matloom.model import Graph
from matloom.operators.graph import components
from matloom.runtime import Saved, Workspace

SHINGLE, SEED = 3, 42
MAX_BITS = 2
#: Fingerprints of one table value beyond which they are indexed more finely.
LIST = 32
#: Shingles whose bits are unpacked at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes; zero without words."""
    import xxhash

    # bytes.lower changes A-Z only, and bytes.split parts words at the six separators.
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = map(b" ".join, zip(*(words[i:] for i in range(k))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        part = h[i : i + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` of every row and its fingerprint as a signed long."""
    keep = [c for c in keep if c not in (name, "_text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("_text").cast(pa.large_binary())
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(prints.view("<i8"))], [*keep, name])

    bound_batches(docs)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    return rows.mapInArrow(work, copy(rows.drop("_text").schema).add(name, "long"))


def _bits(fp: Column, first: int, count: int) -> Column:
    """``count`` bits of a fingerprint from bit ``first`` on, as a long."""
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << count) - 1).cast("long"))


def _ball(value: Column, count: int, radius: int) -> Column:
    """``(value, used)`` for the value and, at radius one, those with one more bit set."""
    own = F.array(F.struct(value.alias("value"), F.lit(0).alias("used")))
    if not radius:
        return own
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(count)])
    unset = F.filter(masks, lambda m: value.bitwiseAND(m) == 0)
    return F.concat(own, F.transform(unset, lambda m: F.struct(value.bitwiseOR(m).alias("value"), F.lit(1).alias("used"))))


def _lookup(ws: Workspace, table: DataFrame, probes: DataFrame, key: list[str]) -> tuple[DataFrame, Saved]:
    """The entries of the lists too long to be read, and what the probes meet.

    ``table`` has ``key`` and ``dst``, ``probes`` has ``key``, ``src`` and ``used``.
    A long list is met as one row without ``dst``.
    """
    table = ws.save(table).df
    sizes = ws.save(table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST)).df
    short = table.join(sizes, key, "left_anti")
    long = table.join(sizes.select(*key), key)
    met = probes.join(short.unionByName(sizes.select(*key, F.lit(None).cast("long").alias("dst"))), key)
    far = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS
    met = met.where(F.col("dst").isNull() | (far & (F.col("src") != F.col("dst"))))
    return long, ws.save(met, long=F.count_if(F.col("dst").isNull()))


def links(ws: Workspace, prints: DataFrame) -> DataFrame:
    """All pairs ``(src, dst)``, ``src < dst``, of distinct ``fp`` within the radius."""
    # Many probes are made of each row: deal the few bytes out to all tasks first.
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = prints.select("fp").repartition(spread, "fp")
    halves = F.array(*[F.struct(F.lit(h).alias("half"), _bits(F.col("fp"), 32 * h, 32).alias("value")) for h in (0, 1)])
    table = fps.select(F.col("fp").alias("dst"), F.explode(halves).alias("k")).select("k.half", "k.value", "dst")
    balls = F.array(*[F.struct(F.lit(h).alias("half"), _ball(_bits(F.col("fp"), 32 * h, 32), 32, 1).alias("ball")) for h in (0, 1)])
    probes = fps.select(F.col("fp").alias("src"), F.explode(balls).alias("k")).select("src", "k.half", F.explode("k.ball").alias("p"))
    probes = probes.select("src", "half", "p.value", "p.used")
    long, met = _lookup(ws, table, probes, ["half", "value"])
    pairs = [met.df.where("dst IS NOT NULL").select("src", "dst")]

    if met.stats["long"]:
        # The other half in quarters: a quarter of it differs in at most half of the bits left.
        other = lambda fp, q: F.when(F.col("half") == 0, _bits(fp, 32 + 16 * q, 16)).otherwise(_bits(fp, 16 * q, 16))
        quarters = F.array(*[F.struct(F.lit(q).alias("quarter"), other(F.col("dst"), q).alias("part")) for q in (0, 1)])
        table = long.select("half", "value", "dst", F.explode(quarters).alias("k")).select("half", "value", "k.quarter", "k.part", "dst")

        def finer(q: int) -> Column:
            part = other(F.col("src"), q)
            ball = F.when(F.col("used") == 0, _ball(part, 16, 1)).otherwise(_ball(part, 16, 0))
            return F.struct(F.lit(q).alias("quarter"), ball.alias("ball"))

        again = met.df.where("dst IS NULL").select("src", "half", "value", "used", F.explode(F.array(finer(0), finer(1))).alias("k"))
        again = again.select("src", "half", "value", "used", "k.quarter", F.explode("k.ball").alias("p"))
        probes = again.select("src", "half", "value", "quarter", F.col("p.value").alias("part"), (F.col("used") + F.col("p.used")).alias("used"))
        _, met = _lookup(ws, table, probes, ["half", "value", "quarter", "part"])
        pairs.append(met.df.where("dst IS NOT NULL").select("src", "dst"))

        if met.stats["long"]:
            # 48 bits are given; the ball of the rest names whole fingerprints.
            first = F.when(F.col("half") == 0, F.lit(32)).otherwise(F.lit(0)) + F.when(F.col("quarter") == 0, F.lit(16)).otherwise(F.lit(0))
            at = lambda q: F.when(F.col("half") == 0, F.lit(32)).otherwise(F.lit(0)) + 16 * q
            shift = lambda v, by: F.call_function("shiftleft", v, by)
            half = F.when(F.col("half") == 0, F.lit(0)).otherwise(F.lit(32))
            given = shift(F.col("value"), half).bitwiseOR(shift(F.col("part"), at(F.col("quarter"))))
            rest = F.call_function("shiftrightunsigned", F.col("src"), first).bitwiseAND(F.lit(0xFFFF).cast("long"))
            one = [1 << b for b in range(16)]
            flips = [[0], one, [x | y for x in one for y in one if x < y]]
            masks = F.array(*[F.struct(F.lit(u).alias("bits"), F.lit(m).cast("long").alias("mask")) for u, ms in enumerate(flips) for m in ms])
            hot = met.df.where("dst IS NULL").select("src", given.alias("given"), rest.alias("rest"), first.alias("first"), (MAX_BITS - F.col("used")).alias("left"))
            tried = hot.select("src", "given", "rest", "first", "left", F.explode(masks).alias("m")).where(F.col("m.bits") <= F.col("left"))
            dst = F.col("given").bitwiseOR(shift(F.col("rest").bitwiseXOR(F.col("m.mask")), F.col("first")))
            tried = tried.select("src", dst.alias("dst")).where("src != dst").distinct()
            pairs.append(tried.join(prints.select(F.col("fp").alias("dst")), "dst").select("src", "dst"))
    found = reduce(DataFrame.unionAll, pairs)
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def group_prints(ws: Workspace, prints: DataFrame) -> DataFrame:
    """``(fp, group)`` for distinct fingerprints; ``group`` names the component."""
    edges = ws.save(links(ws, prints)).df
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    comp = components(ws, Graph(edges, ends))
    return prints.join(comp.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    ws = Workspace(docs.sparkSession, file_factor=1)
    rows = ws.save(fingerprints(docs, ["doc_id"])).df
    firsts = ws.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first"))).df
    grouped = ws.save(group_prints(ws, firsts.select("fp"))).df
    names = grouped.join(firsts, "fp").groupBy("group").agg(F.min("first").alias("component_id"))
    named = grouped.join(names, "group").select("fp", "component_id")
    # A fingerprint may belong to a third of all rows: left to skew handling.
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = similar_texts.SHINGLE, least: float = similar_texts.LEAST) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id.

    Near-duplicates are texts whose shingle sets have a Jaccard similarity of
    ``least``.  Fingerprints of these shingles are searched as in op3 and what they
    find is compared exactly; their radius misses pairs of that similarity, which
    the rounds of ``similar_texts`` find afterwards.
    """
    ws = Workspace(docs.sparkSession, file_factor=1)
    with Workspace(docs.sparkSession, file_factor=1) as search:
        grouped = similar_texts.similar_groups(search, docs, fingerprint, group_prints, shingle, least)
        counted = ws.save(grouped.groupBy("group", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))).df
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = counted.groupBy("group").agg(F.min(order).alias("k"))
    marked = ws.save(counted.join(first, "group").withColumn("keep", order.eqNullSafe(F.col("k"))).select("doc_id", "digest", "n", "keep")).df
    # Most rows stay: the few that go are looked up, without moving the texts.
    gone = similar_texts.small_side(ws.save(marked.where("NOT keep"), rows=F.count(F.lit(1))))
    own = similar_texts.digest(F.col("text"))
    among = lambda ids: docs.doc_id.eqNullSafe(ids.doc_id) & own.eqNullSafe(ids.digest)
    chosen = docs.join(gone, among(gone), "left_anti")
    several = ws.save(marked.where("keep AND n > 1"), rows=F.count(F.lit(1)))
    if not several.rows:
        return chosen
    # Rows of one id with equal texts: one of them stays.
    several = similar_texts.small_side(several)
    mine = F.struct(*[docs[c] for c in docs.columns])
    again = docs.join(several, among(several)).groupBy(several.doc_id, several.digest).agg(F.first(mine).alias("r"))
    return chosen.join(several, among(several), "left_anti").unionByName(again.select("r.*"))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))

"""Direct factorisation by dense panels on a nested dissection.

The vertices of one separator, or of one uncut part, are eliminated together as a
dense block.  All blocks of one depth of the dissection are independent, so the
factor takes one round of jobs per depth instead of one per dependency level.  A
block's cells meet in one task, where its inverse and the products it sends to
the rows of its ancestors are dense matrix products; sums of products are formed
before they are filed under the depth that reads them.

Pivots are chosen inside a block by its eigenvalues (symmetric) or singular
values (general); those too small to divide by are replaced by a tiny multiple of
the block's size and counted, and solves then refine their answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.model import Graph, SparseMatrix, Vector
from matloom.operators.dissection import dissect
from matloom.operators.factor import PivotError
from matloom.runtime import RoundLog, Workspace

KINDS = ("positive", "indefinite", "general")
#: Vertices of parts that are not cut any more.
LEAF = 96
#: Most rows of a block with the rows it updates; its matrices stay below 130 MB.
MAX_FRONT = 4096
#: Pivots below this share of a block's largest are replaced by it.
TINY = 1e-12

_PANEL = "node long, piv array<long>, rows array<long>, inverse array<double>, left array<double>, right array<double>, negative int, tiny int, bad int"


class FrontError(ArithmeticError):
    """A block with its updated rows is too large for one task."""


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``node`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy()
        last = int(np.searchsorted(node, node[-1], "left"))
        if held and held[-1].column("node")[-1].as_py() != node[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _inverse(block: np.ndarray, kind: str) -> tuple[np.ndarray, int, int, int]:
    """``(inverse, negative, tiny, bad)`` of a diagonal block."""
    if kind == "general":
        u, s, vt = np.linalg.svd(block)
        least = TINY * max(float(s[0]), np.finfo(float).tiny)
        small = s < least
        return (vt.T / np.where(small, max(least, TINY), s)) @ u.T, 0, int(small.sum()), 0
    value, q = np.linalg.eigh(block)
    if kind == "positive":
        bad = int((value <= 0).sum())
        return (q / np.where(value > 0, value, 1.0)) @ q.T, 0, 0, bad
    least = TINY * max(float(np.abs(value).max()), np.finfo(float).tiny)
    small = np.abs(value) < least
    value = np.where(small, np.where(value < 0, -1.0, 1.0) * max(least, TINY), value)
    return (q / value) @ q.T, int((value < 0).sum()), int(small.sum()), 0


def _panel(i: np.ndarray, j: np.ndarray, v: np.ndarray, kind: str, max_front: int) -> tuple:
    """One block from all its cells; see ``_PANEL``."""
    piv = np.unique(i[i == j])
    rows = np.setdiff1d(np.concatenate([i, j]), piv)
    p, r = len(piv), len(rows)
    if p + r > max_front:
        return piv, rows, *(np.empty(0),) * 3, 0, 0, 2
    at = np.concatenate([piv, rows])
    by = np.argsort(at)
    x, y = by[np.searchsorted(at[by], i)], by[np.searchsorted(at[by], j)]
    front = np.zeros((p + r, p + r))
    np.add.at(front, (x, y), v)
    if kind != "general":
        # Cells come from the upper triangle; each is mirrored, the diagonal is not.
        front[:p, :p] += np.triu(front[:p, :p], 1).T + np.tril(front[:p, :p], -1).T
        front[p:, :p] = front[:p, p:].T
    inverse, negative, tiny, bad = _inverse(front[:p, :p], kind)
    right = front[:p, p:] if kind == "general" else np.empty((0, 0))
    return piv, rows, inverse.ravel(), front[p:, :p].ravel(), right.ravel(), negative, tiny, bad


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0), *arrays]), kind))


def _factored(kind: str, max_front: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PANEL.split(", ")]
        for table in _groups(batches):
            node, i, j, v = (table.column(c).to_numpy() for c in ("node", "i", "j", "v"))
            cut = np.flatnonzero(np.append(True, np.diff(node) != 0))
            size, out = 0, []
            for a, b in zip(cut, [*cut[1:], len(node)]):
                out.append((int(node[a]), *_panel(i[a:b], j[a:b], v[a:b], kind, max_front)))
                size += sum(len(x) for x in out[-1][1:6])
                if size > 1 << 20 or b == len(node):
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cols[0], pa.int64()),
                            *[_lists(cols[k], pa.int64()) for k in (1, 2)],
                            *[_lists(cols[k], pa.float64()) for k in (3, 4, 5)],
                            *[pa.array(cols[k], pa.int32()) for k in (6, 7, 8)],
                        ],
                        names,
                    )
                    size, out = 0, []

    return work


def _arrays(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    columns = [batch.column(c) for c in names]
    for k in range(batch.num_rows):
        yield tuple(c[k].values.to_numpy(zero_copy_only=False) if c[k].is_valid else np.empty(0) for c in columns)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells ``(i, j, v)`` that the rows of each block receive."""
    for batch in batches:
        for rows, inverse, left, right in _arrays(batch, "rows", "inverse", "left", "right"):
            if not len(rows):
                continue
            r, p = len(rows), int(len(inverse) ** 0.5)
            left = left.reshape(r, p)
            update = -(left @ inverse.reshape(p, p)) @ (right.reshape(p, r) if len(right) else left.T)
            x, y = (np.indices((r, r)).reshape(2, -1)) if len(right) else np.triu_indices(r)
            for a in range(0, len(x), 1 << 18):
                part = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(rows[x[part]]), pa.array(rows[y[part]]), pa.array(update[x[part], y[part]])], ["i", "j", "v"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``w`` = inverse · z and what it takes from the other rows."""
    for batch in batches:
        out = []
        for inverse, left, z in _arrays(batch, "inverse", "left", "z"):
            p = len(z)
            w = inverse.reshape(p, p) @ z
            out.append((w, left.reshape(-1, p) @ w))
        lists = [_lists([o[k] for o in out], pa.float64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("rows"), *lists], ["node", "rows", "w", "s"])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x = w − inverse · right · x of the other rows."""
    for batch in batches:
        out = []
        for inverse, left, right, w, x in _arrays(batch, "inverse", "left", "right", "w", "x"):
            p = len(w)
            over = right.reshape(p, -1) if len(right) else left.reshape(-1, p).T
            out.append(w - inverse.reshape(p, p) @ (over @ x) if len(x) else w)
        yield pa.RecordBatch.from_arrays([batch.column("piv"), _lists(out, pa.float64())], ["piv", "x"])


class PanelFactor:
    """Factor ``a`` once, solve for many right-hand sides.

    ``kind``: "positive" needs a positive definite matrix, "indefinite" a
    symmetric one; "general" takes any matrix.
    """

    def __init__(self, ws: Workspace, a: SparseMatrix, kind: str, leaf: int = LEAF, max_front: int = MAX_FRONT):
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        self.ws, self.n, self.kind, self.max_front = ws, a.nrows, kind, max_front
        g = Graph.of(a)
        counts = g.undirected().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
        degrees = g.vertices.join(counts, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))
        cutting = dissect(ws, g, leaf)
        order = cutting.permutation(ws, degrees).df.toDF("pos", "id")
        rows = ws.save(cutting.tree.join(order, "id").select("id", "pos", "depth", F.element_at("path", -1).alias("part"))).df
        names = rows.groupBy("depth", "part").agg(F.min("pos").alias("node"))
        place = ws.save(rows.hint("merge").join(names, ["depth", "part"]).select("id", "pos", "node", "depth"), deepest=F.max("depth"))
        self.place, self.depths = place.df, (place.stats["deepest"] if place.stats["deepest"] is not None else -1) + 1
        self.panels = RoundLog(ws, _PANEL)
        self.negative = self.tiny = 0
        self._run(a)

    def _owned(self, cells: DataFrame) -> DataFrame:
        """Cells with the block that eliminates the earlier of their two rows."""
        owner = self.place.select(F.col("pos").alias("o"), "node", "depth")
        return cells.withColumn("o", F.least("i", "j")).join(owner, "o").select("node", "i", "j", "v", "depth")

    def _run(self, a: SparseMatrix) -> None:
        ws = self.ws
        i = self.place.select(F.col("id").alias("i"), F.col("pos").alias("pi"))
        j = self.place.select(F.col("id").alias("j"), F.col("pos").alias("pj"))
        cells = a.entries().join(i, "i").join(j, "j").select(F.col("pi").alias("i"), F.col("pj").alias("j"), "v")
        if self.kind != "general":
            cells = cells.where("i <= j")
        # Every row has a diagonal cell, so that a block knows its pivots.
        cells = cells.unionAll(self.place.select("pos", "pos", F.lit(0.0)))
        base = ws.save(self._owned(cells), partition_by="depth").path
        sent, schema = ws.new_path("sent"), "node long, i long, j long, v double"
        for depth in range(self.depths - 1, -1, -1):
            here = ws.part(base, schema, "depth", depth).unionAll(ws.part(sent, schema, "depth", depth))
            panels = here.repartition("node").sortWithinPartitions("node").mapInArrow(_factored(self.kind, self.max_front), _PANEL)
            total = lambda c: F.coalesce(F.sum(c), F.lit(0))
            done = self.panels.append(panels, bad=F.coalesce(F.max("bad"), F.lit(0)), negative=total("negative"), tiny=total("tiny"))
            if done.stats["bad"] == 2:
                raise FrontError(f"a block at depth {depth} has more than {self.max_front} rows")
            if done.stats["bad"]:
                raise PivotError(f"a block at depth {depth} is not positive definite")
            self.negative += done.stats["negative"]
            self.tiny += done.stats["tiny"]
            if depth:
                made = done.df.select("rows", "inverse", "left", "right").mapInArrow(_products, "i long, j long, v double")
                ws.file(self._owned(made.groupBy("i", "j").agg(F.sum("v").alias("v"))), sent, "depth")

    @property
    def inertia(self) -> tuple[int, int]:
        """Numbers of negative and of other eigenvalues, by Sylvester's law."""
        if self.kind != "indefinite":
            raise ValueError("the inertia comes with kind 'indefinite'")
        return self.negative, self.n - self.negative

    def _panels_at(self, depth: int) -> DataFrame:
        return self.ws.spark.read.schema(_PANEL).parquet(f"{self.panels.path}/round={self.depths - 1 - depth}")

    def forward(self, b: Vector) -> RoundLog:
        """``(node, rows, w, s)`` of every block, one round per depth, deepest first."""
        ws = self.ws
        base = ws.save(b.df.withColumnRenamed("i", "id").join(self.place, "id").select("node", F.col("pos").alias("i"), "v", "depth"), partition_by="depth").path
        owner = self.place.select(F.col("pos").alias("i"), "node", "depth")
        sent, schema = ws.new_path("sent"), "node long, i long, v double"
        log = RoundLog(ws, "node long, rows array<long>, w array<double>, s array<double>")
        for depth in range(self.depths - 1, -1, -1):
            here = ws.part(base, schema, "depth", depth).unionAll(ws.part(sent, schema, "depth", depth))
            z = here.groupBy("node", "i").agg(F.sum("v").alias("v")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("z"))
            met = self._panels_at(depth).join(z, "node").select("node", "rows", "inverse", "left", "z")
            done = log.append(met.mapInArrow(_forward, log.schema))
            if depth:
                pairs = done.df.select(F.explode(F.arrays_zip("rows", "s")).alias("e")).select(F.col("e.rows").alias("i"), F.col("e.s").alias("v"))
                sums = pairs.groupBy("i").agg((-F.sum("v")).alias("v")).join(owner, "i").select("node", "i", "v", "depth")
                ws.file(sums, sent, "depth")
        return log

    def backward(self, halves: RoundLog) -> Vector:
        """The solution from the blocks that ``forward`` left."""
        ws, log = self.ws, RoundLog(self.ws, "i long, v double")
        for depth in range(self.depths):
            panels = self._panels_at(depth)
            w = ws.spark.read.schema(halves.schema).parquet(f"{halves.path}/round={self.depths - 1 - depth}").select("node", "w")
            met = panels.join(w, "node")
            if depth:
                above = panels.select("node", F.posexplode("rows").alias("k", "i")).join(log.all().select("i", "v"), "i")
                x = above.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "v")))["v"].alias("x"))
                met = met.join(x, "node", "left")
            else:
                met = met.withColumn("x", F.array().cast("array<double>"))
            found = met.select("piv", "inverse", "left", "right", "w", "x").mapInArrow(_backward, "piv array<long>, x array<double>")
            log.append(found.select(F.explode(F.arrays_zip("piv", "x")).alias("e")).select(F.col("e.piv").alias("i"), F.col("e.x").alias("v")))
        named = self.place.select(F.col("pos").alias("i"), "id")
        return Vector(log.all().select("i", "v").join(named, "i").select(F.col("id").alias("i"), "v"), self.n)

    def __call__(self, b: Vector) -> Vector:
        return self.backward(self.forward(b))

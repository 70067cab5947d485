"""Smoothed aggregation: a hierarchy of coarser matrices and a V-cycle over it.

Roots of aggregates are a maximal set of vertices of which no two are within two
strong steps, found by random priorities in rounds over all vertices at once; a
vertex then has at most one root beside it.  The prolongator spreads the
indicator of the aggregates by one damped Jacobi step, so coarse matrices stay
sparse products of tables.  The smoother is the diagonal sparse approximate
inverse, which needs each row once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.functions.scan import dense_position
from matloom.model import SparseMatrix, Vector
from matloom.operators.products import matvec, ptap
from matloom.operators.panels import PanelFactor
from matloom.runtime import Workspace

#: Entry (i, j) is strong if its square exceeds STRONG² times both diagonals;
#: every level halves the bound.
STRONG = 0.08
#: Rows of the coarsest matrix whose dense inverse is kept, and most levels.
COARSE, MAX_LEVELS = 400, 20
#: Smoothing steps before and after the coarser levels of a cycle.
SWEEPS = 2
#: A level that keeps more than this share of the rows is not worth its cost.
STALL = 0.8


def strong_arcs(a: SparseMatrix, eps: float) -> DataFrame:
    """``(src, dst, w)`` of the strong entries off the diagonal, with their size."""
    d = a.df.where("i = j").select("i", F.abs("v").alias("d"))
    off = a.entries().where("i <> j").join(d.withColumnRenamed("d", "di"), "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    strong = off.where(F.col("v") * F.col("v") > eps * eps * F.col("di") * F.col("dj"))
    return strong.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.abs("v").alias("w"))


def distant_roots(ws: Workspace, arcs: DataFrame, seed: int = 42) -> DataFrame:
    """``(id)``: a maximal set of vertices with more than two steps between any two.

    A vertex is taken when its priority is the highest within two steps among the
    undecided; then all within two steps of it are decided.
    """
    vertices = arcs.select(F.col("src").alias("id")).distinct()
    hop = arcs.select("src", "dst").unionAll(vertices.select("id", "id"))
    hop = ws.save(hop).df
    state = ws.save(vertices.select("id", F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id").alias("p")), left=F.count("p"))
    roots = None
    while state.stats["left"]:
        # Decided vertices still pass on what lies two steps away.
        near = state.df.select(F.col("id").alias("dst"), "p")
        one = hop.join(near, "dst").groupBy(F.col("src").alias("dst")).agg(F.max("p").alias("p"))
        two = hop.join(one, "dst").groupBy(F.col("src").alias("id")).agg(F.max("p").alias("top"))
        new = ws.save(state.df.hint("merge").join(two, "id").where("p = top").select("id"))
        beside = hop.join(new.df.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("src")).distinct()
        around = hop.join(beside, "src").select(F.col("dst").alias("id")).distinct().withColumn("gone", F.lit(True))
        nxt = state.df.join(around, "id", "left").select("id", F.when(F.col("gone").isNull(), F.col("p")).alias("p"))
        nxt = ws.save(nxt, left=F.count("p"))
        ws.discard(state)
        roots = new.df if roots is None else roots.unionAll(new.df)
        state = nxt
    return vertices.limit(0) if roots is None else roots


def aggregates(ws: Workspace, arcs: DataFrame) -> tuple[DataFrame, int]:
    """``(id, agg)`` of all vertices with a strong arc, and the number of aggregates."""
    numbered = ws.save(dense_position(ws, distant_roots(ws, arcs), [F.col("id")], "agg"), rows=F.count(F.lit(1)))
    first = arcs.join(numbered.df.select(F.col("id").alias("dst"), "agg"), "dst").select(F.col("src").alias("id"), "agg")
    core = ws.save(numbered.df.select("id", "agg").unionAll(first)).df
    # The rest is two steps from a root: it joins its strongest neighbour's.
    outer = arcs.join(core.select(F.col("id").alias("src"), F.lit(1).alias("placed")), "src", "left_anti")
    best = outer.join(core.select(F.col("id").alias("dst"), "agg"), "dst").groupBy("src").agg(F.max(F.struct("w", (-F.col("agg")).alias("m"))).alias("b"))
    return ws.save(core.unionAll(best.select(F.col("src").alias("id"), (-F.col("b.m")).alias("agg")))).df, numbered.rows


def smoothed_prolongator(ws: Workspace, a: SparseMatrix, arcs: DataFrame, member: DataFrame, count: int) -> SparseMatrix:
    """(I − ω·D⁻¹·A)·P₀ for the indicator P₀ of the aggregates, where weak entries
    of A are added to its diagonal and ω is 4/3 over a bound of the spectrum."""
    strong = arcs.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(True).alias("strong"))
    rows = a.entries().join(strong.hint("merge"), ["i", "j"], "left")
    keep = (F.col("i") == F.col("j")) | F.col("strong")
    lumped = rows.groupBy("i", F.when(keep, F.col("j")).otherwise(F.col("i")).alias("j")).agg(F.sum("v").alias("v"))
    lumped = ws.save(lumped).df
    d = lumped.where("i = j").select("i", F.col("v").alias("d"))
    own = F.sum(F.when(F.col("i") == F.col("j"), F.col("v")))
    sizes = lumped.where("i IS NOT NULL").groupBy("i").agg(F.sum(F.abs("v")).alias("s"), own.alias("d"))
    bound = sizes.where("d IS NOT NULL").agg(F.max(F.col("s") / F.abs("d")).alias("b")).first()["b"]
    step = lumped.join(d, "i").select("i", F.col("j").alias("k"), (F.lit(-4.0 / 3.0 / bound) * F.col("v") / F.col("d")).alias("v"))
    start = member.select(F.col("id").alias("k"), F.col("agg").alias("j"))
    spread = step.join(start, "k").select("i", "j", "v")
    kept = start.select(F.col("k").alias("i"), "j", F.lit(1.0).alias("v"))
    cells = kept.unionAll(spread).groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")
    return SparseMatrix(ws.save(cells).df, a.nrows, count)


@dataclass(frozen=True)
class Level:
    a: SparseMatrix
    smoother: DataFrame  # (i, m)
    p: SparseMatrix


class Multigrid:
    """One V-cycle as a preconditioner of a symmetric positive definite matrix."""

    def __init__(self, ws: Workspace, a: SparseMatrix, strong: float = STRONG, coarse: int = COARSE, max_levels: int = MAX_LEVELS):
        self.ws, self.levels = ws, []
        a = SparseMatrix(ws.save(a.entries()).df, a.nrows, a.ncols)
        self.sizes = [a.nrows]
        while a.nrows > coarse and len(self.levels) < max_levels:
            arcs = ws.save(strong_arcs(a, strong)).df
            member, count = aggregates(ws, arcs)
            if not count or count > STALL * a.nrows:
                break
            p = smoothed_prolongator(ws, a, arcs, member, count)
            self.levels.append(Level(a, self._smoother(a), p))
            a = SparseMatrix(ws.save(ptap(a, p).df).df, count, count)
            self.sizes.append(count)
            strong /= 2
        self.last = a
        self._direct = PanelFactor(ws, a, "positive") if a.nrows > coarse else None
        self._inverse = None if self._direct else self._dense_inverse(a)

    def _smoother(self, a: SparseMatrix) -> DataFrame:
        """m_i = a_ii / Σ_j a_ij², the diagonal M that brings M·A closest to I."""
        own = F.sum(F.when(F.col("i") == F.col("j"), F.col("v")))
        return self.ws.save(a.df.groupBy("i").agg((own / F.sum(F.col("v") * F.col("v"))).alias("m"))).df

    def _dense_inverse(self, a: SparseMatrix) -> SparseMatrix:
        """Of at most ``COARSE`` rows, so its cells are bounded."""
        m = np.zeros((a.nrows, a.nrows))
        for r in a.df.collect():
            m[r["i"], r["j"]] += r["v"]
        inverse = np.linalg.pinv(m, hermitian=True)
        i, j = np.nonzero(inverse)
        cells = self.ws.spark.createDataFrame([(int(x), int(y), float(inverse[x, y])) for x, y in zip(i, j)], "i long, j long, v double")
        return SparseMatrix(self.ws.save(cells).df, a.nrows, a.nrows)

    def _cycle(self, k: int, b: Vector) -> Vector:
        if k == len(self.levels):
            return self._direct(b) if self._direct else matvec(self._inverse, b)
        level, ws, n = self.levels[k], self.ws, b.n
        x = b.df.join(level.smoother, "i").select("i", (F.col("m") * F.col("v")).alias("v"))
        for _ in range(SWEEPS - 1):
            x = ws.save(self._smoothed(level, x, b)).df
        left = matvec(level.a, Vector(x, n), alpha=-1.0, beta=1.0, x=b)
        down = Vector(ws.save(matvec(level.p, left, trans=True).df).df, level.p.ncols)
        up = matvec(level.p, self._cycle(k + 1, down)).df.withColumnRenamed("v", "e")
        x = ws.save(x.join(up, "i").select("i", (F.col("v") + F.col("e")).alias("v"))).df
        for _ in range(SWEEPS):
            x = ws.save(self._smoothed(level, x, b)).df
        return Vector(x, n)

    @staticmethod
    def _smoothed(level: Level, x: DataFrame, b: Vector) -> DataFrame:
        """x + M·(b − A·x)."""
        left = matvec(level.a, Vector(x, b.n), alpha=-1.0, beta=1.0, x=b).df.withColumnRenamed("v", "r")
        return x.join(left, "i").join(level.smoother, "i").select("i", (F.col("v") + F.col("m") * F.col("r")).alias("v"))

    def __call__(self, r: Vector) -> Vector:
        return self._cycle(0, r)

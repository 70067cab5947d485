"""Triangular solves by dependency level, and by exact repeated sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.model import SparseMatrix, Vector
from matloom.operators.graph import level_schedule, triangle_needs
from matloom.runtime import Pinned, RoundLog, Saved, Workspace


class TriangularSolve:
    """Analyse one triangle once, solve for many right-hand sides.

    ``side`` picks the strict triangle of ``a``; ``diag`` is None for a unit
    diagonal.  ``a`` may hold the other triangle too; it is ignored.  ``by``
    chooses what ``apply`` does: "levels" for one pass over the triangle in as
    many rounds as it has levels, "sweeps" for few jobs that each read the whole
    triangle, which suits shallow ones.
    """

    CHAIN = 6  # sweeps planned as one job

    def __init__(self, ws: Workspace, a: SparseMatrix, side: str, diag: Vector | None = None, by: str = "levels"):
        if by not in ("levels", "sweeps"):
            raise ValueError(f"unknown way of solving {by!r}")
        self.ws, self.n, self.by = ws, a.nrows, by
        strict = a.df.where("j < i" if side == "lower" else "j > i")
        self.diag = None if diag is None else diag.df.withColumnRenamed("v", "d")
        self.levels, self.depth = level_schedule(ws, triangle_needs(strict, side), ws.spark.range(self.n))
        self._strict, self._filed, self._inner = strict, None, None

    def _start(self, b: Vector) -> DataFrame:
        rows = b.df.select("i", F.col("v").alias("b"))
        if self.diag is None:
            return rows.withColumn("d", F.lit(1.0))
        return rows.join(self.diag, "i")

    def solve(self, b: Vector) -> Vector:
        """Level by level: a solved level sends its products to the rows that
        wait for them, filed under the level that will read them.  Every entry,
        row and product is written once and read once."""
        row_level = self.levels.select(F.col("id").alias("i"), "level")
        if self._filed is None:
            col_level = self.levels.select(F.col("id").alias("j"), F.col("level").alias("at"))
            filed = self._strict.select("i", "j", "v").join(row_level, "i").join(col_level, "j")
            self._filed = self.ws.save(filed, partition_by="at").path
        start = self.ws.save(self._start(b).join(row_level, "i"), partition_by="level").path
        sent, log = self.ws.new_path("sent"), RoundLog(self.ws, "i long, v double")
        for level in range(self.depth):
            rows = self.ws.part(start, "i long, b double, d double", "level", level)
            if level:
                due = self.ws.part(sent, "i long, s double", "level", level).groupBy("i").agg(F.sum("s").alias("s"))
                rows = rows.join(due, "i", "left").withColumn("b", F.col("b") - F.coalesce("s", F.lit(0.0)))
            done = log.append(rows.select("i", (F.col("b") / F.col("d")).alias("v"))).df
            if level + 1 < self.depth:
                solved = done.select(F.col("i").alias("j"), F.col("v").alias("x"))
                here = self.ws.part(self._filed, "i long, j long, v double, level int", "at", level).join(solved, "j")
                self.ws.file(here.groupBy("i", "level").agg(F.sum(F.col("v") * F.col("x")).alias("s")), sent, "level")
        return Vector(log.all().select("i", "v"), self.n)

    def sweep(self, b: Vector) -> Vector:
        """x ← D⁻¹(b − N·x), repeated depth − 1 times, which is exact because N
        is nilpotent.  Rows of the first level are known at once and send their
        products once; only the rows behind them are swept again."""
        if self._inner is None:
            level = self.levels.select(F.col("id").alias("i"), "level")
            self._rows = self.ws.save(level if self.diag is None else level.join(self.diag, "i")).df
            first = self.levels.where("level = 0").select(F.col("id").alias("j"), F.lit(True).alias("first"))
            cells = self._strict.select("i", "j", "v").join(first, "j", "left")
            cells = self.ws.save(cells.select("i", "j", "v", F.coalesce("first", F.lit(False)).alias("first"))).df
            self._outer = Pinned(self.ws, cells.where("first").drop("first"), "j")
            self._inner = Pinned(self.ws, cells.where("NOT first").drop("first"), "j")
        rows = b.df.select("i", F.col("v").alias("b")).join(self._rows, "i", "left" if self.diag is None else "inner")
        d = F.lit(1.0) if self.diag is None else F.col("d")
        start = self.ws.save(rows.select("i", "b", d.alias("d"), F.coalesce("level", F.lit(0)).alias("level"))).df
        solved = start.where("level = 0").select("i", (F.col("b") / F.col("d")).alias("v"))
        if self.depth < 2:
            return Vector(solved, self.n)
        later = self._less(start.where("level > 0").drop("level"), self._outer, solved)
        if self.depth > 2:
            later = self.ws.save(later).df
        x = later.select("i", (F.col("b") / F.col("d")).alias("v"))
        for k in range(2, self.depth):
            x = self._less(later, self._inner, x).select("i", (F.col("b") / F.col("d")).alias("v"))
            if k % self.CHAIN == 0:
                x = self.ws.save(x).df
        return Vector(solved.unionAll(x), self.n)

    @staticmethod
    def _less(rows: DataFrame, cells: Pinned, x: DataFrame) -> DataFrame:
        """``(i, b, d)`` with the products of ``cells`` and ``x`` taken from b."""
        known = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
        sums = cells.join(known).groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
        return rows.join(sums, "i", "left").select("i", (F.col("b") - F.coalesce("s", F.lit(0.0))).alias("b"), "d")

    def apply(self, b: Vector) -> Vector:
        return self.solve(b) if self.by == "levels" else self.sweep(b)


class ContractedSolve:
    """Solves with few jobs where the dependencies are long and narrow.

    With M = −D⁻¹·N the solution is c + M·x for c = D⁻¹·b.  The map composed with
    itself is x ← (c + M·c) + M²·x, so squaring takes as many rounds as the depth
    has binary digits: a chain of n rows needs log₂ n of them.  Squaring goes on
    until nothing is left of M, or while the square has at most ``growth`` times
    the entries of the matrix; beyond that, where levels are wide, the last power
    is applied as often as it changes anything.  The powers are kept for further
    right-hand sides.
    """

    def __init__(self, ws: Workspace, a: SparseMatrix, side: str, diag: Vector | None = None, growth: float = 4.0):
        self.ws, self.n = ws, a.nrows
        strict = a.df.where("j < i" if side == "lower" else "j > i").where("v <> 0")
        self.diag = None if diag is None else diag.df.withColumnRenamed("v", "d")
        m = strict.select("i", "j", (-F.col("v")).alias("v"))
        if self.diag is not None:
            m = m.join(self.diag, "i").select("i", "j", (F.col("v") / F.col("d")).alias("v"))
        now = ws.save(m, rows=F.count(F.lit(1)))
        most, self.powers = growth * max(now.rows, 1), [now]
        while now.rows:
            left = now.df.select("i", F.col("j").alias("k"), F.col("v").alias("u"))
            right = now.df.select(F.col("i").alias("k"), "j", "v")
            # Counted before it is formed: a hub would send all pairs of its sides.
            sides = left.groupBy("k").agg(F.count(F.lit(1)).alias("x")).join(right.groupBy("k").agg(F.count(F.lit(1)).alias("y")), "k")
            if (sides.agg(F.sum(F.col("x") * F.col("y")).alias("n")).first()["n"] or 0) > most:
                break
            cells = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("v"))
            now = ws.save(cells, rows=F.count(F.lit(1)))
            self.powers.append(now)

    def solve(self, b: Vector) -> Vector:
        ws = self.ws
        rows = b.df.select("i", "v")
        if self.diag is not None:
            rows = rows.join(self.diag, "i").select("i", (F.col("v") / F.col("d")).alias("v"))
        x = ws.save(rows)
        for power in self.powers[:-1]:
            x = ws.save(self._added(x.df, self._times(power, x.df)))
        last = self.powers[-1]
        if last.rows:
            term = x.df
            while True:
                made = ws.save(self._times(last, term), rows=F.count(F.lit(1)))
                if not made.rows:
                    break
                term, x = made.df, ws.save(self._added(x.df, made.df))
        return Vector(x.df, self.n)

    @staticmethod
    def _times(power: Saved, x: DataFrame) -> DataFrame:
        known = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
        return power.df.join(known, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v")).where("v <> 0")

    @staticmethod
    def _added(x: DataFrame, more: DataFrame) -> DataFrame:
        joined = x.join(more.withColumnRenamed("v", "s"), "i", "left")
        return joined.select("i", (F.col("v") + F.coalesce("s", F.lit(0.0))).alias("v"))


def forward_substitution(ws: Workspace, lower: SparseMatrix, b: Vector) -> Vector:
    """Unit lower triangle: x_i = b_i − Σ L_ij x_j."""
    return TriangularSolve(ws, lower, "lower").solve(b)


def forward_substitution_transposed(ws: Workspace, upper_of_lt: SparseMatrix, b: Vector) -> Vector:
    """The same solve with L handed over as Lᵀ."""
    flipped = upper_of_lt.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return TriangularSolve(ws, upper_of_lt.with_entries(flipped, structure="lower"), "lower").solve(b)


def backward_substitution(ws: Workspace, upper: SparseMatrix, diag: Vector, b: Vector) -> Vector:
    """x_i = (b_i − Σ_{j>i} U_ij x_j) / d_i."""
    return TriangularSolve(ws, upper, "upper", diag).solve(b)

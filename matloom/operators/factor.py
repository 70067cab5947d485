"""Numeric incomplete and complete factorisations by pivot level.

Pivots that do not touch each other are eliminated in one job.  The updates of
a pattern are worked out once: only products whose target is stored, found as
triangles of the pattern, each edge expanded from its lighter end.  A hub that
is eliminated early therefore sends as many updates as it has triangles, not all
pairs of its neighbours.  Updates are summed before they are written and filed
under the level that reads them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matloom.functions.scan import rank_within
from matloom.model import SparseMatrix, Vector
from matloom.operators import fill
from matloom.operators.graph import level_schedule
from matloom.operators.triangular import TriangularSolve
from matloom.runtime import RoundLog, Workspace

# Retry rule of the shifted factorisations.
FIRST_SHIFT = 1e-3
MAX_RESTARTS = 20


class PivotError(ArithmeticError):
    """A pivot was zero, missing, or not positive where it must be."""


@dataclass(frozen=True)
class Factor:
    """``chol``: upper U with A ≈ UᵀU.  ``lu``: unit lower part and U together."""

    matrix: SparseMatrix
    kind: str
    shift: float = 0.0


def triangles(edges: DataFrame) -> DataFrame:
    """``(q, a, b)``, q < a < b, for all triangles of ``(a, b)`` edges, a < b.

    Every edge points from its end of lower degree to the other, so no vertex
    has more than about √(2·edges) heads, and pairs of heads are few.
    """
    ends = edges.select(F.col("a").alias("id")).unionAll(edges.select("b"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    weighed = edges.join(degree.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
    weighed = weighed.join(degree.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    light = F.col("na") <= F.col("nb")
    arcs = weighed.select(F.when(light, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(light, F.col("b")).otherwise(F.col("a")).alias("w"))
    wedges = arcs.withColumnRenamed("w", "a").join(arcs.withColumnRenamed("w", "b"), "u").where("a < b")
    closed = wedges.join(edges, ["a", "b"], "left_semi")
    q, b = F.least("u", "a"), F.greatest("u", "b")
    return closed.select(q.alias("q"), (F.col("u") + F.col("a") + F.col("b") - q - b).alias("a"), b.alias("b"))


class Elimination:
    """The schedule and the updates of one pattern ``(i, j)``, for any values.

    An update ``(q, x, y)`` takes the product of pivot q's cells towards x and y
    from cell (x, y).
    """

    def __init__(self, ws: Workspace, cells: DataFrame, n: int, kind: str):
        self.ws, self.kind = ws, kind
        stored = ws.save(cells.select("i", "j")).df
        edges = stored.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
        edges = ws.save(edges).df
        levels, self.depth = level_schedule(ws, edges.select(F.col("b").alias("id"), F.col("a").alias("on")), ws.spark.range(n))
        levels = ws.save(levels).df
        owner = levels.withColumnRenamed("id", "o")
        self.cells = ws.save(stored.withColumn("o", F.least("i", "j")).join(owner, "o").select("i", "j", "level")).df
        found = triangles(edges)
        off = found.select("q", F.col("a").alias("x"), F.col("b").alias("y"))
        if kind == "lu":
            found = ws.save(found).df
            both = found.select("q", F.col("a").alias("x"), F.col("b").alias("y")).unionAll(found.select("q", "b", "a"))
            off = both.join(stored.toDF("x", "y"), ["x", "y"], "left_semi").select("q", "x", "y")
        own = edges.select(F.col("a").alias("q"), F.col("b").alias("x"), F.col("b").alias("y"))
        reader = owner.withColumnRenamed("level", "level_to")
        filed = off.unionAll(own).withColumn("o", F.least("x", "y")).join(reader, "o").drop("o")
        filed = filed.join(levels.select(F.col("id").alias("q"), "level"), "q")
        self.updates = ws.save(filed, partition_by="level", rows=F.count(F.lit(1)))

    def run(self, a: DataFrame) -> DataFrame:
        """Factor the entries ``a`` ``(i, j, v)``; cells without one start at zero."""
        ws, kind = self.ws, self.kind
        base = self.cells.join(a.select("i", "j", "v"), ["i", "j"], "left")
        base = ws.save(base.select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"), "level"), partition_by="level").path
        sent, log = ws.new_path("updates"), RoundLog(ws, "i long, j long, v double, p double")
        for level in range(self.depth):
            here = ws.part(base, "i long, j long, v double", "level", level)
            if level:
                due = ws.part(sent, "i long, j long, s double", "level", level)
                due = due.groupBy("i", "j").agg(F.sum("s").alias("s"))
                here = here.join(due, ["i", "j"], "left").select("i", "j", (F.col("v") - F.coalesce("s", F.lit(0.0))).alias("v"))
            pivots = here.where("i = j").select(F.col("i").alias("o"), F.col("v").alias("p"))
            rows = here.withColumn("o", F.least("i", "j")).join(pivots, "o", "left")
            if kind == "chol":
                value = F.when(F.col("i") == F.col("j"), F.sqrt(F.greatest("p", F.lit(0.0)))).otherwise(
                    F.col("v") / F.sqrt(F.when(F.col("p") > 0, F.col("p")))
                )
                bad = F.count_if(F.col("p").isNull() | (F.col("p") <= 0) | F.isnan("p"))
            else:
                value = F.when(F.col("i") > F.col("j"), F.col("v") / F.when(F.col("p") != 0, F.col("p"))).otherwise(F.col("v"))
                bad = F.count_if(F.col("p").isNull() | (F.col("p") == 0) | F.isnan("p"))
            done = log.append(rows.select("i", "j", value.alias("v"), "p"), bad=bad)
            if done.stats["bad"]:
                raise PivotError(f"{done.stats['bad']} entries at level {level} have no usable pivot")
            if level + 1 < self.depth:
                ws.file(self._products(done.df, level), sent, "level")
        return log.all().select("i", "j", "v")

    def _products(self, done: DataFrame, level: int) -> DataFrame:
        """The updates of one level's pivots, summed per target cell."""
        right = done.where("i < j").select(F.col("i").alias("q"), F.col("j").alias("y"), F.col("v").alias("vy"))
        if self.kind == "chol":
            left = right.withColumnsRenamed({"y": "x", "vy": "vx"})
        else:
            left = done.where("i > j").select(F.col("j").alias("q"), F.col("i").alias("x"), F.col("v").alias("vx"))
        listed = self.ws.part(self.updates.path, "q long, x long, y long, level_to int", "level", level)
        met = listed.join(left, ["q", "x"]).join(right, ["q", "y"])
        return met.groupBy(F.col("x").alias("i"), F.col("y").alias("j"), F.col("level_to").alias("level")).agg(
            F.sum(F.col("vx") * F.col("vy")).alias("s")
        )


def _upper(a: SparseMatrix) -> DataFrame:
    return a.df.where("i <= j")


def _on_diagonal(a: DataFrame, value) -> DataFrame:
    return a.withColumn("v", F.when(F.col("i") == F.col("j"), value).otherwise(F.col("v")))


def _shifted(
    ws, a: SparseMatrix, attempt, shift_mode: str, restarts: int, omega: float = 0.0, first_shift: float = FIRST_SHIFT
) -> Factor:
    """Try without a shift, then with growing ones until the pivots hold.

    The diagonal is scaled by 1 + ``omega`` before any shift.
    """
    if shift_mode not in ("add", "mul"):
        raise ValueError(f"unknown shift mode {shift_mode!r}")
    upper = _on_diagonal(_upper(a), F.col("v") * (1.0 + omega))
    low = upper.where("i = j").agg(F.min("v").alias("m")).first()["m"]
    # A factor on the diagonal cannot lift a value that is not positive.
    lift = shift_mode == "add" and not (low is not None and low > 0)
    shift = first_shift - (low or 0.0) if lift else 0.0
    for _ in range(restarts + 1):
        v = F.col("v")
        moved = v * (1.0 + shift) if shift_mode == "mul" else v + F.lit(shift)
        try:
            u = attempt(_on_diagonal(upper, moved))
            return Factor(SparseMatrix(u, a.nrows, a.ncols, "upper"), "chol", shift)
        except PivotError:
            shift = max(first_shift, 2.0 * shift)
    raise PivotError(f"no positive pivots after {restarts} restarts")


def incomplete_cholesky(
    ws: Workspace, a: SparseMatrix, k: int = 0, shift_mode: str = "add", restarts: int = MAX_RESTARTS,
    omega: float = 0.0, first_shift: float = FIRST_SHIFT,
) -> Factor:
    """IC(k) of a symmetric matrix; only its upper triangle is read.

    Pivots that fail are met by a growing ``shift_mode`` shift of the diagonal
    ("add" or "mul") that begins with ``first_shift``; ``omega`` scales the
    diagonal by 1 + omega from the start.
    """
    plan = Elimination(ws, fill.ic_pattern(ws, _upper(a), k), a.nrows, "chol")
    return _shifted(ws, a, plan.run, shift_mode, restarts, omega, first_shift)


def incomplete_lu(ws: Workspace, a: SparseMatrix, k: int = 0, repair: tuple[float, float] | None = None) -> Factor:
    """ILU(k).  ``repair`` = (threshold, value) replaces small stored diagonals,
    and fills missing ones, before the elimination."""
    entries = a.entries()
    if repair is not None:
        small, value = repair
        ids = ws.spark.range(a.nrows).select(F.col("id").alias("i"), F.col("id").alias("j"))
        stored = entries.where("i = j")
        fixed = ids.join(stored, ["i", "j"], "left").select(
            "i", "j", F.when(F.abs(F.coalesce("v", F.lit(0.0))) < small, F.lit(value)).otherwise(F.col("v")).alias("v")
        )
        entries = entries.where("i <> j").unionByName(fixed)
    cells = fill.ilu_pattern(ws, entries, k)
    return Factor(SparseMatrix(Elimination(ws, cells, a.nrows, "lu").run(entries), a.nrows, a.ncols), "lu")


def complete_cholesky(ws: Workspace, a: SparseMatrix) -> Factor:
    cells = fill.complete_pattern(ws, _upper(a), ws.spark.range(a.nrows))
    u = Elimination(ws, cells, a.nrows, "chol").run(_upper(a))
    return Factor(SparseMatrix(u, a.nrows, a.ncols, "upper"), "chol")


def complete_lu(ws: Workspace, a: SparseMatrix) -> Factor:
    """LU without pivoting on the fill of the symmetrised pattern."""
    both = a.entries().select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    ids = ws.spark.range(a.nrows)
    upper = fill.complete_pattern(ws, both.union(ids.select("id", F.col("id"))), ids)
    cells = upper.union(upper.where("i < j").select("j", "i"))
    return Factor(SparseMatrix(Elimination(ws, cells, a.nrows, "lu").run(a.entries()), a.nrows, a.ncols), "lu")


# -- factorisations that choose their pattern while they run -----------------


def _ready(open_: DataFrame) -> DataFrame:
    """Pivots no open, lower-numbered pivot touches.  Later fill cannot reach
    them either: it would need such a pivot next to them."""
    waiting = open_.where("i <> j").select(F.greatest("i", "j").alias("o")).distinct()
    return open_.where("i = j").select(F.col("i").alias("o")).join(waiting, "o", "left_anti")


def cholesky_with_memory(
    ws: Workspace, a: SparseMatrix, lsize: int = 0, rsize: int = 0, restarts: int = MAX_RESTARTS
) -> Factor:
    """Each row keeps its original entry count plus ``lsize`` largest values;
    the next ``rsize`` take part in the elimination only."""
    upper = ws.save(_upper(a)).df
    quota = upper.where("i < j").groupBy("i").agg(F.count(F.lit(1)).alias("keep"))
    quota = ws.save(quota)

    def attempt(entries: DataFrame) -> DataFrame:
        open_ = ws.save(entries.select("i", "j", "v"))
        log = RoundLog(ws, "i long, j long, v double")
        while open_.rows:
            ready = ws.save(_ready(open_.df))
            pivots = open_.df.where("i = j").select(F.col("i").alias("o"), F.col("v").alias("p")).join(ready.df, "o")
            pivots = ws.save(pivots, bad=F.count_if(F.col("p") <= 0))
            if pivots.stats["bad"] or not pivots.rows:
                raise PivotError("a pivot is not positive or not stored")
            root = F.sqrt("p")
            rows = open_.df.join(pivots.df.withColumnRenamed("o", "i"), "i")
            off = rows.where("i < j").select("i", "j", (F.col("v") / root).alias("v"))
            ranked = rank_within(ws, off, ["i"], [F.abs("v").desc(), F.col("j")], "r").join(quota.df, "i", "left")
            limit = F.coalesce("keep", F.lit(0)) + F.least(F.lit(lsize), F.lit(a.nrows - 1) - F.col("i"))
            kept = ws.save(
                ranked.where(F.col("r") < limit + rsize).select("i", "j", "v", (F.col("r") >= limit).alias("extra"))
            ).df
            diag = rows.where("i = j").select("i", "j", root.alias("v"))
            log.append(kept.where("NOT extra").select("i", "j", "v").unionByName(diag))
            left = kept.select(F.col("i").alias("q"), F.col("j").alias("x"), F.col("v").alias("va"), F.col("extra").alias("ea"))
            right = kept.select(F.col("i").alias("q"), F.col("j").alias("y"), F.col("v").alias("vb"), F.col("extra").alias("eb"))
            pairs = left.join(right, "q").where("x <= y AND NOT (ea AND eb)")
            update = pairs.select(F.col("x").alias("i"), F.col("y").alias("j"), (-F.col("va") * F.col("vb")).alias("v"))
            stays = open_.df.join(ready.df.withColumnRenamed("o", "i"), "i", "left_anti")
            nxt = ws.save(stays.unionByName(update).groupBy("i", "j").agg(F.sum("v").alias("v")))
            ws.discard(open_, ready, pivots)
            open_ = nxt
        return log.all().select("i", "j", "v")

    return _shifted(ws, a.with_entries(upper, structure="sym_upper"), attempt, "add", restarts)


def incomplete_lu_threshold(ws: Workspace, a: SparseMatrix, tau: float = 1e-6, max_fill: int = 2) -> Factor:
    """ILUT: drop values below ``tau`` times their row's norm, then keep the
    ``max_fill`` largest of each row in L and in U besides the diagonal."""
    entries = ws.save(a.entries()).df
    norms = entries.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    norms = ws.save(norms)
    largest = Window.partitionBy("i").orderBy(F.abs("v").desc(), F.col("j"))

    def strongest(df: DataFrame) -> DataFrame:
        # The constant rank bound also runs before the shuffle.
        return df.withColumn("r", F.row_number().over(largest)).where(F.col("r") <= max_fill).drop("r")

    def above(df: DataFrame) -> DataFrame:
        return df.join(norms.df, "i").where(F.abs("v") >= F.lit(tau) * F.col("norm")).drop("norm")

    open_ = ws.save(entries)
    log = RoundLog(ws, "i long, j long, v double")
    while open_.rows:
        ready = ws.save(_ready(open_.df))
        owned = open_.df.withColumn("o", F.least("i", "j")).join(ready.df, "o")
        pivots = owned.where("i = j").select("o", F.col("v").alias("p"))
        pivots = ws.save(pivots, bad=F.count_if(F.col("p") == 0))
        if pivots.stats["bad"] or not pivots.rows:
            raise PivotError("a pivot is zero or not stored")
        upper = strongest(above(owned.where("i < j").select("i", "j", "v")))
        lower = owned.where("i > j").join(pivots.df, "o").select("i", "j", (F.col("v") / F.col("p")).alias("v"))
        lower = above(lower)
        diag = pivots.df.select(F.col("o").alias("i"), F.col("o").alias("j"), F.col("p").alias("v"))
        done = log.append(upper.unionByName(lower).unionByName(diag)).df
        left = done.where("i > j").select("i", F.col("j").alias("q"), F.col("v").alias("va"))
        right = done.where("i < j").select(F.col("i").alias("q"), "j", F.col("v").alias("vb"))
        update = left.join(right, "q").select("i", "j", (-F.col("va") * F.col("vb")).alias("v"))
        stays = open_.df.withColumn("o", F.least("i", "j")).join(ready.df, "o", "left_anti").drop("o")
        nxt = ws.save(stays.unionByName(update).groupBy("i", "j").agg(F.sum("v").alias("v")))
        ws.discard(open_, ready, pivots)
        open_ = nxt
    all_ = log.all().select("i", "j", "v")
    kept = all_.where("i <= j").unionByName(strongest(all_.where("i > j")))
    return Factor(SparseMatrix(kept, a.nrows, a.ncols), "lu")


# -- applying a factor --------------------------------------------------------


class FactorSolve:
    """z = (factor)⁻¹ r, analysed once; ``by`` as in ``TriangularSolve``."""

    def __init__(self, ws: Workspace, f: Factor, by: str = "levels"):
        m = f.matrix
        stored = ws.save(m.df).df
        diag = Vector(ws.save(stored.where("i = j").select("i", "v")).df, m.nrows)
        whole = m.with_entries(stored, structure="general")
        if f.kind == "chol":
            flipped = stored.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
            self.forward = TriangularSolve(ws, m.with_entries(flipped, structure="lower"), "lower", diag, by)
        else:
            self.forward = TriangularSolve(ws, whole, "lower", by=by)
        self.backward = TriangularSolve(ws, whole, "upper", diag, by)

    def __call__(self, r: Vector) -> Vector:
        return self.backward.apply(self.forward.apply(r))


def factor_product(f: Factor) -> DataFrame:
    """The matrix a factor stands for: UᵀU or L·U, as entries."""
    m = f.matrix.df
    if f.kind == "chol":
        left = m.select(F.col("j").alias("i"), F.col("i").alias("k"), F.col("v").alias("va"))
        right = m.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    else:
        ones = m.where("i = j").select("i", F.col("i").alias("k"), F.lit(1.0).alias("va"))
        left = m.where("i > j").select("i", F.col("j").alias("k"), F.col("v").alias("va")).unionByName(ones)
        right = m.where("i <= j").select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))

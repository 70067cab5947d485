"""Krylov solvers on one state table.

A solver keeps all its vectors as columns of one row per index.  A step is one
product job plus one aggregate that yields every scalar of the step; vector
updates are projections that fold into the next product.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.model import SparseMatrix, Vector
from matloom.operators.structure import diagonal
from matloom.runtime import Buckets, Pinned, Saved, Workspace

Preconditioner = Callable[[Vector], Vector]

# Defaults of the solvers.
MAX_ITERS = 1000
REL_TOL = 1e-8
ABS_TOL = 0.0
BREAKDOWN = 1e-16
REORTHOGONALIZE_BELOW = 0.5  # share of ‖w‖² that must survive one pass
SINGLE_PASS_ABOVE = 1e-4  # the same where the products of the basis with itself are known


class NotPositiveDefinite(ArithmeticError):
    """Conjugate gradients met a direction that shows an indefinite matrix."""


class NotConverged(ArithmeticError):
    """An iteration used up its steps before it met its tolerance."""


@dataclass(frozen=True)
class Solution:
    x: Vector
    iterations: int
    converged: bool
    residual: float

    def checked(self) -> Vector:
        """The solution; an error when the tolerance was not met."""
        if not self.converged:
            raise NotConverged(f"residual {self.residual:.3g} after {self.iterations} steps")
        return self.x


class Operator:
    """A matrix laid out for repeated products."""

    def __init__(self, ws: Workspace, a: SparseMatrix, bucket_rows: int | None = None):
        self.ws, self.n = ws, a.nrows
        self.entries = Pinned(ws, a.entries(), "j", bucket_rows)

    def times(self, x: DataFrame, like: Saved | None, name: str = "s") -> DataFrame:
        """``(i, name)`` for ``x`` ``(i, v)``; rows without entries are absent."""
        known = x.select(F.col("i").alias("j"), F.col("v").alias("_x"))
        return self.entries.join(known, like).groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias(name))


def _or_zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.coalesce(F.sum(a * b), F.lit(0.0))


def _residual_state(op: Operator, b: Vector, x: DataFrame | None, like: Saved | None) -> DataFrame:
    """``(i, b, x, r)`` with r = b − A·x."""
    rows = b.df.select("i", F.col("v").alias("b"))
    if x is None:
        return rows.select("i", "b", F.lit(0.0).alias("x"), F.col("b").alias("r"))
    product = op.times(x, like)
    rows = rows.join(x.withColumnRenamed("v", "x"), "i").join(product, "i", "left")
    return rows.select("i", "b", "x", (F.col("b") - _or_zero("s")).alias("r"))


def _done(res: float, norm_b: float, rel_tol: float, abs_tol: float) -> bool:
    return res == 0.0 or res < abs_tol or (norm_b > 0.0 and res / norm_b < rel_tol)


def pcg(
    ws: Workspace,
    a: SparseMatrix,
    b: Vector,
    precond: Preconditioner | str | None = None,
    x0: Vector | None = None,
    max_iters: int = MAX_ITERS,
    rel_tol: float = REL_TOL,
    abs_tol: float = ABS_TOL,
) -> Solution:
    """Preconditioned conjugate gradients for a positive definite matrix.

    ``precond`` is None, "jacobi", or a function r → z.  The first two cost one
    job per step.  A small recurrence residual is confirmed against b − A·x.
    """
    op = Operator(ws, a)
    by_row = precond is None or precond == "jacobi"
    weights = None
    if precond == "jacobi":
        weights = ws.save(diagonal(a, invert=True).df.withColumnRenamed("v", "w"))
    x: DataFrame | None = None if x0 is None else x0.df
    like, used = None, 0
    while True:
        state = _residual_state(op, b, x, like)
        state = state.join(weights.df, "i") if weights else state.withColumn("w", F.lit(1.0))
        if by_row:
            state = state.withColumn("z", F.col("w") * F.col("r"))
        else:
            fixed = ws.save(state)
            z = precond(Vector(fixed.df.select("i", F.col("r").alias("v")), b.n)).df
            state = fixed.df.join(z.withColumnRenamed("v", "z"), "i")
        begun = ws.save(
            state.withColumn("p", F.col("z")),
            rz=_dot(F.col("r"), F.col("z")),
            rr=_dot(F.col("r"), F.col("r")),
            bb=_dot(F.col("b"), F.col("b")),
        )
        state, like = begun.df, begun
        rz, res, norm_b = begun.stats["rz"], math.sqrt(begun.stats["rr"]), math.sqrt(begun.stats["bb"])
        if _done(res, norm_b, rel_tol, abs_tol) or used >= max_iters:
            solved = _done(res, norm_b, rel_tol, abs_tol)
            return Solution(Vector(state.select("i", F.col("x").alias("v")), b.n), used, solved, res)
        previous = begun
        while used < max_iters and not _done(res, norm_b, rel_tol, abs_tol):
            used += 1
            step = op.times(state.select("i", F.col("p").alias("v")), like, "q")
            rows = state.join(step, "i", "left").withColumn("q", _or_zero("q"))
            r, q, w = F.col("r"), F.col("q"), F.col("w")
            at = ws.save(
                rows, pq=_dot(F.col("p"), q), rr=_dot(r, r), rq=_dot(r, q), qq=_dot(q, q),
                wrr=_dot(w * r, r), wrq=_dot(w * r, q), wqq=_dot(w * q, q),
            )
            ws.discard(previous)
            previous, s = at, at.stats
            if not s["pq"] > 0:
                raise NotPositiveDefinite(f"step {used}: p·A·p = {s['pq']}")
            alpha = (s["wrr"] if by_row else rz) / s["pq"]
            res = math.sqrt(max(s["rr"] - 2 * alpha * s["rq"] + alpha * alpha * s["qq"], 0.0))
            new_x = F.col("x") + F.lit(alpha) * F.col("p")
            new_r = r - F.lit(alpha) * q
            if by_row:
                new_rz = max(s["wrr"] - 2 * alpha * s["wrq"] + alpha * alpha * s["wqq"], 0.0)
                new_p = w * new_r + F.lit(new_rz / s["wrr"]) * F.col("p")
                state = at.df.select("i", "b", "w", new_x.alias("x"), new_r.alias("r"), new_p.alias("p"))
                continue
            moved = ws.save(at.df.select("i", "b", "w", "p", new_x.alias("x"), new_r.alias("r")))
            z = precond(Vector(moved.df.select("i", F.col("r").alias("v")), b.n)).df
            with_z = ws.save(
                moved.df.join(z.withColumnRenamed("v", "z"), "i"), rz=_dot(F.col("r"), F.col("z"))
            )
            new_p = F.col("z") + F.lit(with_z.stats["rz"] / rz) * F.col("p")
            rz = with_z.stats["rz"]
            ws.discard(at, moved)
            previous = with_z
            state = with_z.df.select("i", "b", "w", "x", "r", new_p.alias("p"))
        x = state.select("i", F.col("x").alias("v"))


def _combine(coeffs, column: str) -> Column:
    out = F.lit(0.0)
    for k, c in enumerate(coeffs):
        out = out + F.lit(float(c)) * F.col(column)[k]
    return out


def orthogonal_step(ws: Workspace, rows: DataFrame, k: int):
    """Remove from column ``w`` its parts along the ``k`` vectors in array ``V``.

    A second pass runs when the first removed half of ``w`` or more; one pass
    alone would then leave visible parts along the old vectors.  Returns
    the saved rows, the coefficients, the remaining norm and the expression of
    the cleaned vector.
    """
    dots = {f"h{m}": _dot(F.col("w"), F.col("V")[m]) for m in range(k)}
    at = ws.save(rows, ww=_dot(F.col("w"), F.col("w")), **dots)
    h = [at.stats[f"h{m}"] for m in range(k)]
    left = at.stats["ww"] - sum(c * c for c in h)
    if left > REORTHOGONALIZE_BELOW * at.stats["ww"]:
        return at, h, math.sqrt(left), F.col("w") - _combine(h, "V")
    cleaned = at.df.withColumn("w", F.col("w") - _combine(h, "V"))
    again = ws.save(cleaned, ww=_dot(F.col("w"), F.col("w")), **dots)
    h2 = [again.stats[f"h{m}"] for m in range(k)]
    ws.discard(at)
    norm = math.sqrt(max(again.stats["ww"] - sum(c * c for c in h2), 0.0))
    return again, [x + y for x, y in zip(h, h2)], norm, F.col("w") - _combine(h2, "V")


def with_last(gram, last):
    """The products of all basis vectors, given those of the last one."""
    import numpy as np

    k = len(last)
    gram = np.pad(gram[: k - 1, : k - 1], (0, 1))
    gram[k - 1, :] = gram[:, k - 1] = last
    return gram


def remaining(gram, h, ww: float):
    """Coefficients that clean ``w`` of a basis with products ``gram``, and ‖w‖² after.

    ``h`` alone would leave what the basis lacks in orthogonality, times ``h``; a
    second pass over the rows measures that, ``gram`` tells it beforehand.
    """
    c = h + (h - gram @ h)
    return c, ww - 2 * float(c @ h) + float(c @ gram @ c)


def orthogonal_round(ws: Workspace, rows: DataFrame, k: int, gram, buckets: Buckets | None):
    """As :func:`orthogonal_step`, mostly with a single write of the basis.

    Also returns the products of the basis vectors, kept up from ``gram``.
    """
    import numpy as np

    last = F.col("V")[k - 1]
    dots = {f"h{m}": _dot(F.col("w"), F.col("V")[m]) for m in range(k)}
    own = {f"e{m}": _dot(last, F.col("V")[m]) for m in range(k)}
    at = ws.save(rows, buckets=buckets, ww=_dot(F.col("w"), F.col("w")), **dots, **own)
    gram = with_last(gram, [at.stats[f"e{m}"] for m in range(k)])
    h, ww = np.array([at.stats[f"h{m}"] for m in range(k)]), at.stats["ww"]
    c, left = remaining(gram, h, ww)
    if left > SINGLE_PASS_ABOVE * ww:
        return at, c, math.sqrt(left), F.col("w") - _combine(c, "V"), gram
    cleaned = at.df.withColumn("w", F.col("w") - _combine(c, "V"))
    again = ws.save(cleaned, buckets=buckets, ww=_dot(F.col("w"), F.col("w")), **dots)
    h2 = np.array([again.stats[f"h{m}"] for m in range(k)])
    ws.discard(at)
    norm = math.sqrt(max(again.stats["ww"] - float(h2 @ h2), 0.0))
    return again, c + h2, norm, F.col("w") - _combine(h2, "V"), gram


def fgmres(
    ws: Workspace,
    a: SparseMatrix,
    b: Vector,
    left: Preconditioner | None = None,
    right: Preconditioner | None = None,
    x0: Vector | None = None,
    restart: int = 0,
    max_iters: int = MAX_ITERS,
    rel_tol: float = REL_TOL,
    abs_tol: float = ABS_TOL,
) -> Solution:
    """Flexible GMRES; ``right`` acts before A and ``left`` after it.

    The basis is an array column, so orthogonalisation needs no join.  Only the
    small Hessenberg matrix lives on the driver.
    """
    import numpy as np

    op = Operator(ws, a)
    cycle = restart or max_iters
    norm_b = math.sqrt(b.df.agg(_dot(F.col("v"), F.col("v"))).first()[0])
    x: DataFrame | None = None if x0 is None else x0.df
    like, used, res = None, 0, math.inf
    while True:
        state = _residual_state(op, b, x, like)
        if left is not None:
            fixed = ws.save(state)
            pr = left(Vector(fixed.df.select("i", F.col("r").alias("v")), b.n)).df
            state = fixed.df.drop("r").join(pr.withColumnRenamed("v", "r"), "i")
        begun = ws.save(state, rr=_dot(F.col("r"), F.col("r")))
        like, beta = begun, math.sqrt(begun.stats["rr"])
        if _done(beta, norm_b, rel_tol, abs_tol) or used >= max_iters:
            ok = _done(beta, norm_b, rel_tol, abs_tol)
            return Solution(Vector(begun.df.select("i", F.col("x").alias("v")), b.n), used, ok, beta)
        rows = begun.df.select(
            "i", "b", "x", F.array(F.col("r") / beta).alias("V"), F.array().cast("array<double>").alias("Z")
        )
        hess = np.zeros((0, 0))
        previous = begun
        for m in range(min(cycle, max_iters - used)):
            used += 1
            z = rows.select("i", F.col("V")[m].alias("v"))
            if right is not None:
                z = right(Vector(ws.save(z).df, b.n)).df
            w = op.times(z, like, "w")
            if left is not None:
                every = rows.select("i").join(w, "i", "left").select("i", _or_zero("w").alias("v"))
                w = left(Vector(ws.save(every).df, b.n)).df.withColumnRenamed("v", "w")
            joined = rows.join(w, "i", "left").withColumn("w", _or_zero("w"))
            if right is not None:
                joined = joined.join(z.withColumnRenamed("v", "_z"), "i").withColumn("Z", F.concat("Z", F.array("_z"))).drop("_z")
            at, h, below, clean = orthogonal_step(ws, joined, m + 1)
            ws.discard(previous)
            previous = at
            grown = np.zeros((m + 2, m + 1))
            grown[: hess.shape[0], : hess.shape[1]] = hess
            grown[: m + 1, m] = h
            grown[m + 1, m] = below
            hess = grown
            rhs = np.zeros(m + 2)
            rhs[0] = beta
            y, *_ = np.linalg.lstsq(hess, rhs, rcond=None)
            res = float(np.linalg.norm(hess @ y - rhs))
            rows = at.df
            if below < BREAKDOWN or _done(res, norm_b, rel_tol, abs_tol):
                break
            rows = at.df.withColumn("V", F.concat("V", F.array(clean / below))).drop("w")
        basis = "Z" if right is not None else "V"
        final = ws.save(rows.select("i", (F.col("x") + _combine(y, basis)).alias("v")))
        ws.discard(previous)
        x = final.df


def weighted_jacobi(ws: Workspace, a: SparseMatrix, b: Vector, x: Vector, omega: float, sweeps: int = 1) -> Vector:
    """x ← x + ω·D⁻¹·(b − A·x)."""
    op = Operator(ws, a)
    fixed = b.df.withColumnRenamed("v", "b").join(diagonal(a, invert=True).df.withColumnRenamed("v", "w"), "i")
    fixed = ws.save(fixed).df
    state = x.df
    for k in range(sweeps):
        rows = fixed.join(state, "i").join(op.times(state, None), "i", "left")
        value = F.col("v") + F.lit(omega) * F.col("w") * (F.col("b") - _or_zero("s"))
        state = rows.select("i", value.alias("v"))
        if k % 4 == 3:
            state = ws.save(state).df
    return Vector(state, b.n)

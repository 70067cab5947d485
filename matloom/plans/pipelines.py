"""Multi-step analyses built from the operators."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.model import Graph, Permutation, SparseMatrix, Vector
from matloom.operators.ordering import reverse_cuthill_mckee
from matloom.operators.products import diagonal_times_vector, matmul
from matloom.operators.stats import row_scaling
from matloom.operators.structure import permute, permute_vector, scale_two_sided, threshold_columns
from matloom.plans.krylov import NotConverged, Solution
from matloom.plans.solvers import create
from matloom.runtime import BUCKET_ROWS, Buckets, Pinned, Workspace

FREQUENCIES = 5
KEEP_ABOVE = 1e-3


def reorder_scale_solve(
    ws: Workspace, a: SparseMatrix, b: Vector, solver: str = "cg", order: Permutation | None = None, **knobs
) -> Vector:
    """Reorder by reverse Cuthill–McKee, scale both sides by the row norms,
    solve, and map the solution back to the given numbering."""
    order = order or reverse_cuthill_mckee(ws, Graph.of(a))
    moved = permute(a, order, order)
    d = row_scaling(moved)
    d = Vector(ws.save(d.df).df, d.n)
    scaled = scale_two_sided(moved, d)
    scaled = SparseMatrix(ws.save(scaled.df).df, a.nrows, a.ncols, positive_definite=a.positive_definite)
    rhs = diagonal_times_vector(d, permute_vector(b, order))
    rhs = Vector(ws.save(rhs.df).df, b.n)
    y = create(solver, ws, scaled, **knobs)(rhs)
    y = y.checked() if isinstance(y, Solution) else y
    return permute_vector(diagonal_times_vector(d, y), order.inverse())


def frequencies(low: float, high: float, count: int = FREQUENCIES) -> list[float]:
    """Equally spaced values from ``low`` to ``high``."""
    return [low + (high - low) * k / (count - 1) for k in range(count)]


def shifted_solves(
    ws: Workspace, k: SparseMatrix, m: SparseMatrix, ports: SparseMatrix, freqs: list[float],
    rel_tol: float = 1e-10, max_iters: int = 1000,
) -> DataFrame:
    """Solve (f·M + K)·x = G·e_p for all frequencies and ports at once.

    Raises :class:`NotConverged` when a system misses its tolerance, as one whose
    matrix is not positive definite does.  Rows of the result are ``(sys, f, i, v)``
    with sys = p·|f| + f's position.  All systems advance together by conjugate
    gradients scaled with their diagonals.  The systems of a port reach the same
    rows, so one row ``(port, i)`` holds them all, the matrix pair is stored once,
    and step lengths come from a table with one row per port.
    """
    pair = k.entries().select("i", "j", F.col("v").alias("kv"), F.lit(0.0).alias("mv")).unionByName(
        m.entries().select("i", "j", F.lit(0.0).alias("kv"), F.col("v").alias("mv"))
    )
    pair = ws.save(pair.groupBy("i", "j").agg(F.sum("kv").alias("kv"), F.sum("mv").alias("mv"))).df
    diag = pair.where("i = j").select("i", F.col("kv").alias("kd"), F.col("mv").alias("md"))
    # Each entry knows the diagonal of its row, for rows that a search reaches later.
    entries = Pinned(ws, pair.join(diag, "i", "left"), "j", BUCKET_ROWS)
    slots = range(len(freqs))
    name = lambda c: [f"{c}{s}" for s in slots]
    x, r, p, q, w = ([F.col(c) for c in name(c)] for c in "xrpqw")
    # A row without a positive diagonal is not scaled.
    scale = [F.when(d > 0, 1 / d).otherwise(1.0) for d in (F.col("kd") + F.lit(float(f)) * F.col("md") for f in freqs)]
    rhs = ports.df.select(F.col("j").alias("port"), "i", F.col("v").alias("b")).where("port IS NOT NULL")
    state = rhs.join(diag, "i", "left").select(
        "port", "i", "kd", "md", *[F.lit(0.0).alias(c) for c in name("x")], *[F.col("b").alias(c) for c in name("r")],
        *[(w * F.col("b")).alias(c) for w, c in zip(scale, name("p"))],
    )
    goals = rhs.groupBy("port").agg((F.sum(F.col("b") * F.col("b")) * rel_tol * rel_tol).alias("goal"))
    least, count = goals.agg(F.min("goal"), F.count(F.lit(1)) * len(freqs)).first()
    # Every system rests below its share, so together they pass the stop test.
    share = least / count
    buckets = Buckets.of(k.nrows, "port", "i")
    at = ws.save(buckets.deal(state) if buckets else state, buckets=buckets)
    state = at.df
    for _ in range(max_iters):
        known = state.select("port", F.col("i").alias("j"), *name("p"))
        sums = [F.sum((F.col("kv") + F.lit(float(f)) * F.col("mv")) * c).alias(n) for f, c, n in zip(freqs, p, name("q"))]
        product = entries.join(known).groupBy("port", "i").agg(*sums, F.max("kd").alias("_kd"), F.max("md").alias("_md"))
        rows = state.join(product, ["port", "i"], "full").select(
            "port", "i", F.coalesce("kd", "_kd").alias("kd"), F.coalesce("md", "_md").alias("md"),
            *[F.coalesce(c, F.lit(0.0)).alias(c) for kind in "xrpq" for c in name(kind)],
        )
        nxt = ws.save(rows, buckets=buckets, rr=F.sum(sum(c * c for c in r)))
        ws.discard(at)
        at = nxt
        if at.stats["rr"] <= least:
            break
        scaled = at.df.withColumns(dict(zip(name("w"), scale)))
        totals = {"pq": (p, q), "rr": (r, r), "wrr": (w, r, r), "wrq": (w, r, q), "wqq": (w, q, q)}
        per_port = scaled.groupBy("port").agg(
            *[F.sum(reduce(mul, (v[s] for v in vs))).alias(f"{n}{s}") for n, vs in totals.items() for s in slots]
        )
        alpha, beta = {}, {}
        for s in slots:
            pq, rr, wrr, wrq, wqq = (F.col(f"{n}{s}") for n in totals)
            a = F.col(f"alpha{s}")
            alpha[f"alpha{s}"] = F.when((rr > share) & (pq > 0), wrr / F.when(pq > 0, pq)).otherwise(0.0)
            after = F.greatest(wrr - 2 * a * wrq + a * a * wqq, F.lit(0.0))
            beta[f"beta{s}"] = F.when(a > 0, after / wrr).otherwise(0.0)
        steps = per_port.withColumns(alpha).withColumns(beta).select("port", *alpha, *beta)
        alphas, betas = [F.col(c) for c in alpha], [F.col(c) for c in beta]
        new_r = [c - a * d for c, a, d in zip(r, alphas, q)]
        state = scaled.join(steps, "port").select(
            "port", "i", "kd", "md",
            *[(c + a * d).alias(n) for c, a, d, n in zip(x, alphas, p, name("x"))],
            *[c.alias(n) for c, n in zip(new_r, name("r"))],
            *[(e * c + b * d).alias(n) for e, c, b, d, n in zip(w, new_r, betas, p, name("p"))],
        )
    else:
        rests = [F.sum(c * c).alias(n) for c, n in zip(r, name("r"))]
        left = at.df.groupBy("port").agg(*rests).agg(*[F.sum((c > share).cast("int")) for c in r]).first()
        raise NotConverged(f"{sum(left)} of {count} systems after {max_iters} steps")
    each = F.array(*[F.struct(F.lit(s).alias("fi"), F.lit(float(f)).alias("f"), c.alias("v")) for s, f, c in zip(slots, freqs, x)])
    found = at.df.select("port", "i", F.inline(each))
    return found.select((F.col("port") * len(freqs) + F.col("fi")).alias("sys"), "f", "i", "v")


def reduced_basis(solutions: DataFrame, tol: float = KEEP_ABOVE) -> DataFrame:
    """Vᵀ as ``(i, j, v)``: one row per system, scaled to peak 1 and pruned."""
    kept = threshold_columns(solutions.select(F.col("sys").alias("i"), F.col("i").alias("j"), "v"), ["i"], tol)
    return kept.select("i", "j", "v")


def reduce_model(
    ws: Workspace, k: SparseMatrix, m: SparseMatrix, g: SparseMatrix, low: float, high: float
) -> dict[str, SparseMatrix]:
    """Vᵀ·K·V, Vᵀ·M·V and Vᵀ·G for the basis of shifted solutions."""
    freqs = frequencies(low, high)
    v = ws.save(reduced_basis(shifted_solves(ws, k, m, g, freqs))).df
    vt = SparseMatrix(v, g.ncols * len(freqs), k.nrows)
    return {
        "K": matmul(matmul(vt, k), vt, trans_b=True),
        "M": matmul(matmul(vt, m), vt, trans_b=True),
        "G": matmul(vt, g),
        "V": vt,
    }

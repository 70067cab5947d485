"""Eigenvalue iterations and orthonormal bases."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.model import DenseMatrix, SparseMatrix, Vector
from matloom.operators.products import matvec
from matloom.plans.krylov import NotConverged, Operator, orthogonal_round
from matloom.plans.solvers import DirectSolver
from matloom.runtime import BUCKET_ROWS, Buckets, Workspace
from matloom.sources.generators import _unit

# Defaults of the eigenvalue iterations.
NEV, MAX_ITERS, NCV, TOL = 1, 1000, 20, 1e-4
DEPENDENT = 1e-12  # share of a column outside the span of those before it, below which it is replaced
EXHAUSTED = 1e-10  # remaining norm, against the projected matrix, that ends a basis


@dataclass(frozen=True)
class EigenPair:
    value: float
    vector: Vector
    iterations: int
    converged: bool


def power_iteration(
    ws: Workspace,
    a: SparseMatrix,
    start: Vector,
    b: SparseMatrix | None = None,
    which: str = "L",
    tol: float = TOL,
    max_iters: int = MAX_ITERS,
) -> EigenPair:
    """Largest ("L") or smallest eigenvalue of A·x = λ·B·x; stops once two
    successive directions enclose an angle below ``tol``."""
    if which == "L":
        matrix, inverse = a, None if b is None else DirectSolver(ws, b)
    else:
        matrix, inverse = b, DirectSolver(ws, a)
    op = None if matrix is None else Operator(ws, matrix)
    state = ws.save(start.df, vv=F.sum(F.col("v") * F.col("v")))
    norm, value = math.sqrt(state.stats["vv"]), math.nan
    x = state.df.select("i", (F.col("v") / norm).alias("v"))
    previous, converged, used = None, False, 0
    while used < max_iters and not converged:
        used += 1
        y = x
        if op is not None:
            product = op.times(x, state)
            y = x.select("i").join(product, "i", "left").select("i", F.coalesce("s", F.lit(0.0)).alias("v"))
        if inverse is not None:
            y = inverse.solve(Vector(ws.save(y).df, start.n)).df
        both = x.withColumnRenamed("v", "x").join(y.withColumnRenamed("v", "y"), "i")
        at = ws.save(both, xy=F.sum(F.col("x") * F.col("y")), yy=F.sum(F.col("y") * F.col("y")))
        ws.discard(previous)
        previous = at
        norm = math.sqrt(at.stats["yy"])
        value = at.stats["xy"] if which == "L" else 1.0 / at.stats["xy"]
        cosine = min(1.0, abs(at.stats["xy"]) / norm)
        converged = math.acos(cosine) < tol
        x = at.df.select("i", (F.col("y") / norm).alias("v"))
    return EigenPair(value, Vector(x, start.n), used, converged)


def lanczos(
    ws: Workspace,
    a: SparseMatrix,
    start: Vector,
    nev: int = NEV,
    which: str = "L",
    ncv: int = NCV,
    tol: float = TOL,
    mass: Vector | None = None,
    shift: float | None = None,
    max_iters: int = MAX_ITERS,
    partial: bool = False,
) -> list[EigenPair]:
    """Extremal eigenpairs of a symmetric matrix, optionally against a diagonal
    ``mass``, by Lanczos with full re-orthogonalisation.

    ``shift`` switches to (A − shift·B)⁻¹ and returns the eigenvalues nearest
    to it.  The basis grows to ``ncv`` vectors, and on until the wanted pairs
    meet ``tol``; pairs that do not within ``max_iters`` steps are an error
    unless ``partial`` asks for them.  The basis is an array column; only the small projected matrix and
    the wanted coefficients reach the driver.
    """
    import numpy as np

    scaled, root = a, None
    if mass is not None:
        root = ws.save(mass.df.select("i", F.sqrt("v").alias("d")))
        left = root.df.select("i", F.col("d").alias("di"))
        right = root.df.select(F.col("i").alias("j"), F.col("d").alias("dj"))
        df = a.entries().join(left, "i").join(right, "j").select("i", "j", (F.col("v") / F.col("di") / F.col("dj")).alias("v"))
        scaled = a.with_entries(df, structure="general")
    inverse, op = None, None
    if shift is None:
        op = Operator(ws, scaled, BUCKET_ROWS)
    else:
        ids = ws.spark.range(a.nrows).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(-float(shift)).alias("v"))
        moved = scaled.entries().unionByName(ids).groupBy("i", "j").agg(F.sum("v").alias("v"))
        kind = "positive" if a.positive_definite and shift <= 0 else "indefinite"
        inverse = DirectSolver(ws, SparseMatrix(moved, a.nrows, a.ncols), kind)
    buckets = Buckets.of(start.n, "i")
    begun = ws.save(buckets.deal(start.df) if buckets else start.df, buckets=buckets, vv=F.sum(F.col("v") * F.col("v")))
    rows = begun.df.select("i", F.array(F.col("v") / math.sqrt(begun.stats["vv"])).alias("V"))
    steps = min(max(ncv, max_iters), a.nrows)
    t = gram = np.zeros((0, 0))

    def wanted(theta):
        order = np.argsort(-abs(theta)) if shift is not None else np.argsort(-theta if which == "L" else theta)
        return order[:nev]

    def all_close():
        theta, s = np.linalg.eigh(t)
        return all(abs(last * s[-1, k]) <= tol * max(1.0, abs(theta[k])) for k in wanted(theta))

    at, used, last = None, 0, 0.0
    for m in range(steps):
        used = m + 1
        v = rows.select("i", F.col("V")[m].alias("v"))
        if inverse is not None:
            w = inverse.solve(Vector(ws.save(v).df, start.n)).df.withColumnRenamed("v", "w")
        else:
            w = op.times(v, begun, "w")
        joined = rows.join(w, "i", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        done = at
        at, h, last, clean, gram = orthogonal_round(ws, joined, m + 1, gram, buckets)
        ws.discard(done)
        t = np.pad(t, (0, 1))
        t[: m + 1, m] = h
        t[m, : m + 1] = h
        rows = at.df.drop("w")
        if last <= EXHAUSTED * abs(t).max() or used == steps or (used >= ncv and all_close()):
            break
        rows = at.df.withColumn("V", F.concat("V", F.array(clean / last))).drop("w")
    theta, s = np.linalg.eigh(t)
    ritz = theta if shift is None else shift + 1.0 / theta
    pairs = []
    for k in wanted(theta):
        parts = F.lit(0.0)
        for m in range(used):
            parts = parts + F.lit(float(s[m, k])) * F.col("V")[m]
        x = rows.select("i", parts.alias("v"))
        if root is not None:
            x = x.join(root.df, "i").select("i", (F.col("v") / F.col("d")).alias("v"))
        error = abs(last * s[used - 1, k])
        pairs.append(EigenPair(float(ritz[k]), Vector(x, start.n), used, bool(error <= tol * max(1.0, abs(theta[k])))))
    if not partial and not all(p.converged for p in pairs):
        raise NotConverged(f"{sum(not p.converged for p in pairs)} of {len(pairs)} eigenpairs after {used} steps")
    return pairs


def eigen_residual(a: SparseMatrix, pair: EigenPair, mass: Vector | None = None) -> DataFrame:
    """One row: ‖A·v − λ·B·v‖ / ‖v‖ for the identity or a diagonal B."""
    product = matvec(a, pair.vector).df.withColumnRenamed("v", "av")
    rows = product.join(pair.vector.df, "i")
    weight = F.lit(1.0)
    if mass is not None:
        rows, weight = rows.join(mass.df.withColumnRenamed("v", "mv"), "i"), F.col("mv")
    gap = F.col("av") - F.lit(pair.value) * weight * F.col("v")
    return rows.agg((F.sqrt(F.sum(gap * gap)) / F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("residual"))


def orthonormalize(ws: Workspace, a: DenseMatrix, fan_in: int = 64) -> DenseMatrix:
    """Orthonormal columns spanning a tall matrix with few columns.

    Row blocks are reduced to small triangles with a Householder QR, triangles
    are stacked ``fan_in`` at a time until one is left, and Q = A·R⁻¹ is formed
    by rows.  A second pass restores full orthogonality.  A column that depends
    on those before it is replaced by pseudo-random numbers first, so the basis
    is complete for any rank; that needs at least as many rows as columns.  No
    task ever holds more than one Arrow batch or ``fan_in`` triangles of ncols².
    """
    import numpy as np

    n = a.ncols
    cells = a.df.select("i", F.struct("j", "v").alias("c"))
    packed = cells.groupBy("i").agg(F.array_sort(F.collect_list("c")).alias("c"))
    rows = ws.save(packed.select("i", F.transform("c", lambda c: c["v"]).alias("row"))).df
    r = _triangle(ws, rows, n, fan_in)
    for attempt in range(n + 1):
        size = np.linalg.norm(r, axis=0)
        gone = np.flatnonzero(abs(np.diag(r)) <= DEPENDENT * size)
        if not len(gone):
            break
        if a.nrows < n:
            raise ValueError(f"{n} orthonormal columns need as many rows, not {a.nrows}")
        # One more random column each time that chance leaves it dependent.
        drawn = F.array(*[_unit(attempt, F.col("i"), F.lit(int(k))) - 0.5 if k in gone else F.lit(None).cast("double") for k in range(n)])
        rows = ws.save(rows.select("i", F.zip_with(drawn, "row", lambda new, old: F.coalesce(new, old)).alias("row"))).df
        r = _triangle(ws, rows, n, fan_in)
    for _ in range(2):
        rows = ws.save(_times_inverse(rows, _triangle(ws, rows, n, fan_in))).df
    out = rows.select("i", F.posexplode("row").alias("j", "v"))
    return DenseMatrix(out.select("i", F.col("j").cast("bigint").alias("j"), "v"), a.nrows, n)


def _triangle(ws: Workspace, rows: DataFrame, n: int, fan_in: int):
    """R of the QR factorisation of all rows (n × n, on the driver)."""
    import numpy as np

    def reduce_blocks(batches):
        import numpy as np
        import pandas as pd

        r = np.zeros((0, n))
        for batch in batches:
            block = np.stack(batch["row"].to_numpy()) if len(batch) else np.zeros((0, n))
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        yield pd.DataFrame({"r": [r.ravel()]})

    def stack(batch):
        import numpy as np
        import pandas as pd

        tall = np.vstack([np.asarray(x).reshape(-1, n) for x in batch["r"]])
        return pd.DataFrame({"r": [np.linalg.qr(tall, mode="r").ravel()]})

    parts = ws.save(rows.select("row").mapInPandas(reduce_blocks, "r array<double>"))
    while parts.rows > 1:
        groups = -(-parts.rows // fan_in)
        keyed = parts.df.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
        parts = ws.save(keyed.groupBy("g").applyInPandas(lambda b: stack(b), "r array<double>"))
    r = np.asarray(parts.df.first()["r"]).reshape(-1, n)
    return np.vstack([r, np.zeros((n - r.shape[0], n))]) if r.shape[0] < n else r


def _times_inverse(rows: DataFrame, r) -> DataFrame:
    """row ← row·R⁻¹, with positive diagonal signs."""
    import numpy as np

    signs = np.where(np.diag(r) < 0, -1.0, 1.0)
    inverse = np.linalg.inv(signs[:, None] * r).tolist()

    def solve(batches):
        import numpy as np
        import pandas as pd

        inv = np.asarray(inverse)
        for batch in batches:
            if len(batch):
                q = np.stack(batch["row"].to_numpy()) @ inv
                yield pd.DataFrame({"i": batch["i"], "row": list(q)})

    return rows.mapInPandas(solve, "i long, row array<double>")

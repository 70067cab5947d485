"""Thick-restart Krylov iteration for symmetric and generalised problems.

A·x = λ·B·x with B the identity or a sparse positive definite matrix; vectors are
orthogonal in the inner product of B, of which one factor is made and kept.  The
basis never holds more than ``ncv`` vectors: when it is full, the small projected
matrix is diagonalised and the basis is multiplied by its best columns in one
pass, after which the projected matrix is diagonal with one full row, and goes on
growing.  After every restart the basis and the projected matrix can be committed
below a folder; another session goes on from the last commit.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.model import SparseMatrix, Vector
from matloom.operators.products import matvec
from matloom.plans.eigen import EXHAUSTED, NCV, NEV, TOL, EigenPair
from matloom.plans.krylov import SINGLE_PASS_ABOVE, NotConverged, Operator, remaining, with_last
from matloom.plans.solvers import DirectSolver
from matloom.runtime import BUCKET_ROWS, Buckets, Saved, Workspace

MAX_RESTARTS = 100


def _combined(vectors: Column, c: np.ndarray) -> Column:
    """Σ c_k · vectors[k] for the first ``len(c)`` vectors."""
    terms = F.zip_with(F.slice(vectors, 1, len(c)), F.array(*[F.lit(float(x)) for x in c]), lambda v, x: v * x)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


class KrylovSchur:
    """Extremal eigenpairs: ``which`` "L" or "S", or those nearest to ``shift``.

    ``state`` names a folder in which every restart is committed.
    """

    def __init__(
        self, ws: Workspace, a: SparseMatrix, b: SparseMatrix | None = None, nev: int = NEV, which: str = "L",
        ncv: int = NCV, tol: float = TOL, shift: float | None = None, state: str | None = None,
    ):
        if not nev < ncv:
            raise ValueError("ncv must exceed nev")
        self.ws, self.a, self.b, self.n = ws, a, b, a.nrows
        self.nev, self.which, self.ncv, self.tol = nev, which, min(ncv, a.nrows), tol
        self.shift, self.state = shift, state and state.rstrip("/")
        self.widest = 0
        self._buckets = Buckets.of(self.n, "i")
        self._mass = None if b is None else Operator(ws, b, BUCKET_ROWS)
        self._op = Operator(ws, a, BUCKET_ROWS) if shift is None else None
        self._solver = None
        if shift is not None:
            minus = b.entries() if b is not None else ws.spark.range(self.n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
            minus = minus.withColumn("v", F.lit(-float(shift)) * F.col("v"))
            moved = ws.save(a.entries().unionByName(minus).groupBy("i", "j").agg(F.sum("v").alias("v"))).df
            self._solver = DirectSolver(ws, SparseMatrix(moved, self.n, self.n), "indefinite")
        elif b is not None:
            self._solver = DirectSolver(ws, b, "positive")

    # -- state ------------------------------------------------------------

    def _keep(self, rows: DataFrame, deal: bool = False, **totals: Column) -> Saved:
        """Write rows of the basis so that later rounds need not move them."""
        rows = self._buckets.deal(rows) if deal and self._buckets else rows
        return self.ws.save(rows, buckets=self._buckets, **totals)

    def _commit(self, rows: DataFrame, t: np.ndarray, gram: np.ndarray, restarts: int, steps: int) -> DataFrame:
        """Write the basis, then the small state; readers look for the latter."""
        folder = f"{self.state}/restart={restarts:06d}"
        saved = self.ws.save(rows, path=f"{folder}/rows")
        text = json.dumps({"t": t.tolist(), "gram": gram.tolist(), "steps": steps, "schema": rows.schema.json()})
        self.ws.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/small")
        return saved.df

    def _last(self) -> tuple[DataFrame, np.ndarray, np.ndarray, int, int] | None:
        if self.state is None:
            return None
        folder, fs = self.ws._located(self.state)
        names = sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []
        for name in reversed(names):
            if fs.exists(self.ws._located(f"{self.state}/{name}/small/_SUCCESS")[0]):
                small = json.loads(self.ws.spark.read.text(f"{self.state}/{name}/small").first()["value"])
                from pyspark.sql.types import StructType

                rows = self.ws.spark.read.schema(StructType.fromJson(json.loads(small["schema"]))).parquet(f"{self.state}/{name}/rows")
                gram = np.array(small.get("gram") or np.eye(len(small["t"])))
                rows = self._keep(rows, deal=True).df if self._buckets else rows
                return rows, np.array(small["t"]), gram, int(name.split("=")[1]), small["steps"]
        return None

    # -- iteration --------------------------------------------------------

    def _start(self, start: Vector) -> DataFrame:
        x = self.ws.save(start.df).df
        both = x.withColumn("u", F.col("v")) if self.b is None else x.join(self._mass.times(x, None, "u"), "i", "left").withColumn("u", F.coalesce("u", F.lit(0.0)))
        both = self._keep(both, deal=True, vv=F.sum(F.col("v") * F.col("u")))
        size = math.sqrt(both.stats["vv"])
        rows = both.df.select("i", F.array(F.col("v") / size).alias("V"), F.array(F.col("u") / size).alias("U"))
        return rows if self.b is not None else rows.drop("U")

    def _apply(self, rows: DataFrame, k: int) -> DataFrame:
        """``(i, w, z)``: the operator on vector ``k``, and B times that."""
        v = rows.select("i", F.col("V")[k].alias("v"))
        if self.shift is None:
            z = self._op.times(v, None, "z")
            if self.b is None:
                return z.select("i", F.col("z").alias("w"), "z")
            z = self.ws.save(v.join(z, "i", "left").select("i", F.coalesce("z", F.lit(0.0)).alias("z"))).df
            w = self._solver.solve(Vector(z.withColumnRenamed("z", "v"), self.n)).df
            return w.withColumnRenamed("v", "w").join(z, "i")
        u = v if self.b is None else rows.select("i", F.col("U")[k].alias("v"))
        w = self.ws.save(self._solver.solve(Vector(self.ws.save(u).df, self.n)).df).df
        if self.b is None:
            return w.select("i", F.col("v").alias("w"), F.col("v").alias("z"))
        return w.withColumnRenamed("v", "w").join(self._mass.times(w, None, "z"), "i", "left")

    def _expand(self, rows: DataFrame, m: int, gram: np.ndarray) -> tuple[Saved, np.ndarray, float, Column, Column, np.ndarray]:
        """Operator on the last of ``m`` vectors, made orthogonal to all.

        Returns the written rows with ``w`` and ``z``, the coefficients, the
        remaining length, the finished ``w`` and ``z`` and the products of the
        basis vectors.  Only what is left of a nearly exhausted basis takes a
        second pass.
        """
        own = "V" if self.b is None else "U"
        dots = lambda z, name: {f"{name}{k}": F.sum(F.col("V")[k] * z) for k in range(m)}
        joined = rows.join(self._apply(rows, m - 1), "i", "left")
        joined = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("w", "z")})
        length = F.sum(F.col("w") * F.col("z"))
        one = self._keep(joined, wz=length, **dots(F.col("z"), "h"), **dots(F.col(own)[m - 1], "e"))
        gram = with_last(gram, [one.stats[f"e{k}"] for k in range(m)])
        h, left = remaining(gram, np.array([one.stats[f"h{k}"] for k in range(m)]), one.stats["wz"])
        w, z = F.col("w") - _combined(F.col("V"), h), F.col("z") - _combined(F.col(own), h)
        if left > SINGLE_PASS_ABOVE * one.stats["wz"]:
            return one, h, math.sqrt(left), w, z, gram
        two = self._keep(one.df.withColumns({"w": w, "z": z}), wz=length, **dots(F.col("z"), "h"))
        g = np.array([two.stats[f"h{k}"] for k in range(m)])
        self.ws.discard(one)
        beta = math.sqrt(max(two.stats["wz"] - float(g @ g), 0.0))
        w, z = F.col("w") - _combined(F.col("V"), g), F.col("z") - _combined(F.col(own), g)
        return two, h + g, beta, w, z, gram

    def _order(self, theta: np.ndarray) -> np.ndarray:
        return np.argsort(-abs(theta)) if self.shift is not None else np.argsort(-theta if self.which == "L" else theta)

    def run(self, start: Vector, max_restarts: int = MAX_RESTARTS, partial: bool = False) -> list[EigenPair]:
        """The wanted pairs; an error if some have not converged, unless ``partial``."""
        found = self._last()
        rows, t, gram, restarts, steps = found or (self._start(start), np.zeros((0, 0)), np.zeros((0, 0)), 0, 0)
        m = len(t) + 1
        vectors = ["V"] if self.b is None else ["V", "U"]
        before = None
        while True:
            at, h, beta, w, z, gram = self._expand(rows, m, gram)
            steps += 1
            self.widest = max(self.widest, m)
            t = np.pad(t, ((0, m - len(t)), (0, m - len(t))))
            t[:m, m - 1] = t[m - 1, :m] = h
            over = beta <= EXHAUSTED * abs(t).max()
            if m < self.ncv and not over:
                new = {c: F.concat(c, F.array(x / beta)) for c, x in zip(vectors, (w, z))}
                self.ws.discard(before)
                before, rows, m = at, at.df.select("i", *[new[c].alias(c) for c in vectors]), m + 1
                continue
            theta, s = np.linalg.eigh(t)
            order = self._order(theta)
            error = abs(beta * s[m - 1])
            close = error <= self.tol * np.maximum(1.0, abs(theta))
            ready = over or m == self.n or close[order[: self.nev]].all()
            if ready or restarts >= max_restarts:
                break
            keep = order[: min(self.nev + (self.ncv - self.nev) // 2, m - 1)]
            made = {
                c: F.concat(F.array(*[_combined(F.col(c), s[:, k]) for k in keep]), F.array(x / beta)).alias(c)
                for c, x in zip(vectors, (w, z))
            }
            rows, t, restarts = at.df.select("i", *made.values()), np.diag(theta[keep]), restarts + 1
            gram = s[:, keep].T @ gram @ s[:, keep]
            committed = self._commit(rows, t, gram, restarts, steps) if self.state else None
            kept = None if self.state and self._buckets is None else self._keep(rows)
            rows = committed if kept is None else kept.df
            self.ws.discard(before, at)
            before, m = kept, len(keep) + 1
        pairs = []
        for k in order[: self.nev]:
            value = theta[k] if self.shift is None else self.shift + 1.0 / theta[k]
            x = at.df.select("i", _combined(F.col("V"), s[:, k]).alias("v"))
            pairs.append(EigenPair(float(value), Vector(x, self.n), steps, bool(ready and (over or m == self.n or close[k]))))
        if not partial and not all(p.converged for p in pairs):
            raise NotConverged(f"{sum(not p.converged for p in pairs)} of {len(pairs)} eigenpairs after {restarts} restarts")
        return pairs


def general_residual(a: SparseMatrix, pair: EigenPair, b: SparseMatrix | None = None) -> float:
    """‖A·v − λ·B·v‖ / (|λ|·‖v‖)."""
    av = matvec(a, pair.vector).df.withColumnRenamed("v", "av")
    bv = (pair.vector if b is None else matvec(b, pair.vector)).df.withColumnRenamed("v", "bv")
    gap = F.col("av") - F.lit(pair.value) * F.col("bv")
    r = av.join(bv, "i").join(pair.vector.df, "i").agg(F.sqrt(F.sum(gap * gap)).alias("g"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n")).first()
    return r["g"] / (abs(pair.value) * r["n"])

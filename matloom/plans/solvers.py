"""Direct solves and the registry of named solvers.

Preconditioners of named solvers apply their factors by sweeps, as incomplete
factors are mostly shallow; ``by="levels"`` asks for the level schedule.
"""

from __future__ import annotations

from collections.abc import Callable

from matloom.model import SparseMatrix, Vector
from matloom.operators import factor, products, stats
from matloom.operators.multigrid import Multigrid
from matloom.operators.panels import MAX_FRONT, FrontError, PanelFactor
from matloom.plans.krylov import Solution, fgmres, pcg
from matloom.runtime import Workspace


#: Refinements where pivots of the factor were replaced.
MAX_REFINEMENTS = 5


class DirectSolver:
    """Complete factorisation by dense panels on a nested dissection.

    ``kind`` is "positive", "indefinite" or "general"; by default it follows the
    flag of the matrix.  Solves are refined up to ``max_iter_ref`` times while the
    residual is above ``refine_tol`` of the load, always where pivots had to be
    replaced and otherwise when asked for; one that stays above ``fail_tol`` is an
    error.  A block too large for one task hands the matrix to the elimination by
    cells, in the order given.
    """

    def __init__(self, ws: Workspace, a: SparseMatrix, kind: str | None = None, max_iter_ref: int = 0, refine_tol: float = 1e-12, fail_tol: float = 1e-6, max_front: int = MAX_FRONT):
        self.ws, self.a, self.n = ws, a, a.nrows
        self.kind = kind or ("positive" if a.positive_definite else "general")
        self.refine_tol, self.fail_tol = refine_tol, fail_tol
        self._panels = self._cells = None
        try:
            self._panels = PanelFactor(ws, a, self.kind, max_front=max_front)
        except FrontError:
            f = factor.complete_cholesky(ws, a) if self.kind == "positive" else factor.complete_lu(ws, a)
            self._cells = factor.FactorSolve(ws, f)
        replaced = self._panels is not None and self._panels.tiny
        self.max_iter_ref = max(max_iter_ref, MAX_REFINEMENTS) if replaced else max_iter_ref

    @property
    def inertia(self) -> tuple[int, int]:
        """Numbers of negative and of other eigenvalues (kind "indefinite")."""
        if self._panels is None:
            raise ValueError("the elimination by cells has no inertia")
        return self._panels.inertia

    def forward(self, b: Vector):
        """The first half of a solve, which ``backward`` completes."""
        return self._panels.forward(b) if self._panels else self._cells.forward.apply(b)

    def backward(self, half) -> Vector:
        return self._panels.backward(half) if self._panels else self._cells.backward.apply(half)

    def _once(self, b: Vector) -> Vector:
        return self.backward(self.forward(b))

    def solve(self, b: Vector) -> Vector:
        x, left = self._once(b), None
        if not self.max_iter_ref:
            return x
        size = _length(b)
        x = Vector(self.ws.save(x.df).df, self.n)
        for k in range(self.max_iter_ref + 1):
            r = stats.axpy(-1.0, products.matvec(self.a, x), b)
            r = Vector(self.ws.save(r.df).df, self.n)
            left = _length(r)
            if left <= self.refine_tol * size or k == self.max_iter_ref:
                break
            x = Vector(self.ws.save(stats.axpy(1.0, self._once(r), x).df).df, self.n)
        if left > self.fail_tol * size:
            raise factor.PivotError(f"residual {left:.3g} for a load of {size:.3g} after {self.max_iter_ref} refinements")
        return x


def _length(x: Vector) -> float:
    return stats.vector_norm(x).first()["norm"] or 0.0


Solver = Callable[[Vector], Vector | Solution]
Factory = Callable[..., Solver]

_FACTORIES: dict[str, Factory] = {}


def register(name: str, factory: Factory) -> bool:
    """Add a named factory ``(ws, a, **knobs) → solve(b)``; False if taken."""
    if name in _FACTORIES:
        return False
    _FACTORIES[name] = factory
    return True


def create(name: str, ws: Workspace, a: SparseMatrix, **knobs) -> Solver | None:
    """The named solver for ``a``, analysed and ready; None if unknown."""
    factory = _FACTORIES.get(name)
    return None if factory is None else factory(ws, a, **knobs)


def names() -> list[str]:
    return sorted(_FACTORIES)


def _cg(prepare=None) -> Factory:
    def build(ws: Workspace, a: SparseMatrix, rel_tol: float = 1e-8, abs_tol: float = 0.0, max_iters: int = 1000, by: str = "sweeps", **knobs):
        apply = None if prepare is None else factor.FactorSolve(ws, prepare(ws, a, **knobs), by)
        return lambda b: pcg(ws, a, b, apply, rel_tol=rel_tol, abs_tol=abs_tol, max_iters=max_iters)

    return build


def _cg_amg(ws: Workspace, a: SparseMatrix, rel_tol: float = 1e-8, abs_tol: float = 0.0, max_iters: int = 1000, **knobs) -> Solver:
    cycle = Multigrid(ws, a, **knobs)
    return lambda b: pcg(ws, a, b, cycle, rel_tol=rel_tol, abs_tol=abs_tol, max_iters=max_iters)


def _gmres(prepare=None) -> Factory:
    def build(
        ws: Workspace, a: SparseMatrix, rel_tol: float = 1e-12, abs_tol: float = 1e-15,
        restart: int = 0, max_iters: int = 1000, by: str = "sweeps", **knobs,
    ):
        apply = None if prepare is None else factor.FactorSolve(ws, prepare(ws, a, **knobs), by)
        return lambda b: fgmres(
            ws, a, b, right=apply, restart=restart, rel_tol=rel_tol, abs_tol=abs_tol, max_iters=max_iters
        )

    return build


def _direct(ws: Workspace, a: SparseMatrix, **knobs) -> Solver:
    return DirectSolver(ws, a, **knobs).solve


register("direct", _direct)
register("cg", _cg())
register("cg+ic0", _cg(lambda ws, a: factor.incomplete_cholesky(ws, a, 0)))
register("cg+incomplete_cholesky_k", _cg(lambda ws, a, level=0: factor.incomplete_cholesky(ws, a, level)))
register(
    "cg+incomplete_cholesky_fm",
    _cg(lambda ws, a, lsize=0, rsize=0: factor.cholesky_with_memory(ws, a, lsize, rsize)),
)
register("cg+amg", _cg_amg)
register("gmres", _gmres())
register("gmres+ilu0", _gmres(lambda ws, a: factor.incomplete_lu(ws, a, 0)))
register("gmres+iluk", _gmres(lambda ws, a, level=0: factor.incomplete_lu(ws, a, level)))
register(
    "gmres+ilut",
    _gmres(lambda ws, a, tau=1e-6, max_fill=2: factor.incomplete_lu_threshold(ws, a, tau, max_fill)),
)

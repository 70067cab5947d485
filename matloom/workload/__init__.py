"""Queries over the warehouse tables, one per operator."""

from matloom.workload import factors, files, graphs, matrices, solves
from matloom.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "factors", "files", "graphs", "matrices", "solves"]

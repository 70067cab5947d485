"""Sparse-matrix and graph analytics as Spark DataFrame jobs."""

from matloom.model import DenseMatrix, Graph, Permutation, SparseMatrix, Vector
from matloom.runtime import Workspace

__all__ = ["DenseMatrix", "Graph", "Permutation", "SparseMatrix", "Vector", "Workspace"]

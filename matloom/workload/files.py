"""Round trips through files: a matrix of the tables is written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from matloom.model import SparseMatrix
from matloom.operators import structure
from matloom.runtime import Workspace
from matloom.sources import binary_format, matrix_market, sinks, tables as src
from matloom.workload.registry import query
from matloom.workload.sqltext import SIZES, STIFF, SUPPLY, with_

_A = with_(SUPPLY) + "SELECT i, j, v FROM a"
_K = with_(STIFF) + "SELECT i, j, v FROM k"


@query("file_matrix_market", _A)
def file_matrix_market(spark, sf):
    """The parts that the writer left are one matrix to the reader."""
    path = Workspace(spark).new_path("text")
    sinks.write_matrix_market(src.supply_matrix(spark, sf), path)
    return matrix_market.read_matrix_market(spark, path).df


@query("file_matrix_market_auto", _K)
def file_matrix_market_auto(spark, sf):
    """A symmetric file with its base told from the largest index."""
    path = Workspace(spark).new_path("text")
    sinks.write_matrix_market(structure.to_symmetric(src.stiffness(spark, sf)), path)
    return matrix_market.read_matrix_market(spark, path, base="auto").df


@query("file_parquet", _A)
def file_parquet(spark, sf):
    path = Workspace(spark).new_path("archive")
    sinks.write_matrix(src.supply_matrix(spark, sf), path)
    return sinks.read_matrix(spark, path).df


@query("file_csr", _A)
def file_csr(spark, sf):
    """Row pointers and row-major positions, and the matrix made from them."""
    ws, a = Workspace(spark), src.supply_matrix(spark, sf)
    a = SparseMatrix(ws.save(a.df).df, a.nrows, a.ncols)
    ptr, body = structure.to_csr(ws, a, base=1)
    return structure.from_csr(ws, ptr, body, a.nrows, a.ncols, base=1).df


@query("file_gnuplot", with_(SUPPLY) + "SELECT concat_ws(' ', j, -i) AS line FROM a")
def file_gnuplot(spark, sf):
    path = Workspace(spark).new_path("plot")
    sinks.write_gnuplot(src.supply_matrix(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("file_binary_coo", _A)
def file_binary_coo(spark, sf):
    """A folder of packed records, read in ranges that do not end with its parts."""
    path = Workspace(spark).new_path("packed")
    binary_format.write_coo(src.supply_matrix(spark, sf), path)
    return binary_format.load_coo(spark, path, chunk=1000)


@query("file_binary_coo_base1", _K)
def file_binary_coo_base1(spark, sf):
    """Indices from one, with the members of a record in another order."""
    path = Workspace(spark).new_path("packed")
    binary_format.write_coo(src.stiffness(spark, sf), path, base=1, order="i,j,v")
    return binary_format.load_coo(spark, path, base=1, order="i,j,v")


@query("file_binary_vector", with_(SIZES) + "SELECT i, v FROM x")
def file_binary_vector(spark, sf):
    path = Workspace(spark).new_path("packed")
    binary_format.write_vector(src.part_sizes(spark, sf), path)
    return binary_format.load_vector(spark, path, chunk=100)

"""Matrices and graphs derived from the warehouse tables.

* supply matrix: supplier × part, summed quantities
* trade graph: customers who bought the same part on the same day; each is
  linked to the highest customer key of that day's buyers, so a day with many
  buyers is a star and never all their pairs
* stiffness matrix: Laplacian of the trade graph plus the identity
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.model import DenseMatrix, Graph, SparseMatrix, Vector
from matloom.runtime import Workspace, dealt

_BUILT: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_span(spark: SparkSession, sf_dir: str, name: str, key: str) -> int:
    """Number of rows a key-indexed object needs: largest key + 1."""
    return table(spark, sf_dir, name).agg(F.max(key)).first()[0] + 1


def suppliers(spark, sf_dir) -> int:
    return key_span(spark, sf_dir, "supplier", "s_suppkey")


def parts(spark, sf_dir) -> int:
    return key_span(spark, sf_dir, "part", "p_partkey")


def customers(spark, sf_dir) -> int:
    return key_span(spark, sf_dir, "customer", "c_custkey")


def supply_matrix(spark: SparkSession, sf_dir: str, where: str | None = None) -> SparseMatrix:
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.count()
    if where:
        lines = lines.where(where)
    cells = lines.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    df = dealt(cells, rows, "i", "j").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return SparseMatrix(df, suppliers(spark, sf_dir), parts(spark, sf_dir))


def part_sizes(spark: SparkSession, sf_dir: str) -> Vector:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v"))
    return Vector(df, parts(spark, sf_dir))


def supplier_nations(spark: SparkSession, sf_dir: str) -> Vector:
    """Nation key + 1 of every supplier, as a value."""
    df = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("i"), (F.col("s_nationkey") + 1).cast("double").alias("v")
    )
    return Vector(df, suppliers(spark, sf_dir))


def part_size_classes(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """part × size indicator."""
    df = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("i"), F.col("p_size").cast("bigint").alias("j"), F.lit(1.0).alias("v")
    )
    return SparseMatrix(df, parts(spark, sf_dir), key_span(spark, sf_dir, "part", "p_size"))


def supplier_nation_classes(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """supplier × nation indicator."""
    df = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("bigint").alias("j"), F.lit(1.0).alias("v")
    )
    return SparseMatrix(df, suppliers(spark, sf_dir), key_span(spark, sf_dir, "nation", "n_nationkey"))


def customer_nation_classes(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """customer × nation indicator."""
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("i"), F.col("c_nationkey").cast("bigint").alias("j"), F.lit(1.0).alias("v")
    )
    return SparseMatrix(df, customers(spark, sf_dir), key_span(spark, sf_dir, "nation", "n_nationkey"))


def customer_load(spark: SparkSession, sf_dir: str) -> Vector:
    """Right-hand side: (key mod 7) + 1 for every customer."""
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("i"), (F.col("c_custkey") % 7 + 1).cast("double").alias("v")
    )
    return Vector(df, customers(spark, sf_dir))


def _trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("day"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sales = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "day", "o_custkey")
    # One row per group with at least two different buyers.
    groups = (
        sales.groupBy("l_partkey", "day")
        .agg(F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"))
        .where("low < high")
    )
    return (
        sales.join(groups, ["l_partkey", "day"])
        .where("o_custkey < high")
        .select(F.col("o_custkey").alias("src"), F.col("high").alias("dst"))
        .distinct()
    )


def trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links ``(src, dst)`` with src < dst, written once per session and folder."""
    key = (spark.sparkContext.applicationId, "links", sf_dir)
    if key not in _BUILT:
        _BUILT[key] = Workspace(spark).save(_trade_links(spark, sf_dir)).df
    return _BUILT[key]


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    links = trade_links(spark, sf_dir)
    edges = links.union(links.select("dst", "src"))
    vertices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return Graph(edges, vertices)


def trade_adjacency(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    e = trade_graph(spark, sf_dir).edges
    n = customers(spark, sf_dir)
    return SparseMatrix(e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("v")), n, n)


def laplacian(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Degree on the diagonal of linked customers, −1 per arc; the others have
    no stored entry at all."""
    g = trade_graph(spark, sf_dir)
    off = g.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1.0).alias("v"))
    deg = g.edges.groupBy(F.col("src").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    n = customers(spark, sf_dir)
    return SparseMatrix(off.unionByName(deg.select("i", F.col("i").alias("j"), "v")), n, n)


def stiffness(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Laplacian + identity: symmetric positive definite, integer valued."""
    key = (spark.sparkContext.applicationId, "stiffness", sf_dir)
    n = customers(spark, sf_dir)
    if key not in _BUILT:
        ones = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("i"), F.col("c_custkey").alias("j"), F.lit(1.0).alias("v")
        )
        both = laplacian(spark, sf_dir).df.unionByName(ones)
        _BUILT[key] = Workspace(spark).save(both.groupBy("i", "j").agg(F.sum("v").alias("v"))).df
    return SparseMatrix(_BUILT[key], n, n, positive_definite=True)


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and parts as one vertex set, linked by any delivery; part p is
    vertex (number of suppliers + p)."""
    m = suppliers(spark, sf_dir)
    pairs = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + m).alias("dst"))
        .distinct()
    )
    vertices = (
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
        .union(table(spark, sf_dir, "part").select(F.col("p_partkey") + m))
    )
    return Graph(pairs.union(pairs.select("dst", "src")), vertices)


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DenseMatrix:
    """vec_id × component, widened to double."""
    raw = table(spark, sf_dir, "embeddings")
    cells = raw.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "e"))
    df = cells.select("i", F.col("j").cast("bigint").alias("j"), F.col("e").cast("double").alias("v"))
    top = raw.agg(F.max("vec_id").alias("i"), F.max(F.size("embedding")).alias("d")).first()
    return DenseMatrix(df, top["i"] + 1, top["d"])

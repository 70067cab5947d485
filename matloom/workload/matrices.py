"""Structure, product, sum and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matloom.functions.scan import dense_position
from matloom.model import DenseMatrix, Permutation, SparseMatrix
from matloom.operators import products, stats, structure, sums
from matloom.runtime import Workspace
from matloom.sources import generators, sinks, tables as src
from matloom.workload.registry import query
from matloom.workload.sqltext import (
    ARCS, CELLS, CUSTOMER_NATION, LAPLACE, LOAD, NATIONS, RANKED, SIZES, STIFF, SUPPLIER_NATION, SUPPLY, with_,
)


def balance_order(spark, sf) -> Permutation:
    """Customers ordered by account balance."""
    rows = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("old_id"), "c_acctbal")
    placed = dense_position(Workspace(spark), rows, [F.col("c_acctbal"), F.col("old_id")], "new_id")
    return Permutation(placed.select("new_id", "old_id"), src.customers(spark, sf))


# -- products ---------------------------------------------------------------


@query("spmv", with_(SUPPLY, SIZES) + """
SELECT s_suppkey AS i, coalesce(sum(a.v * x.v), 0) AS v
FROM supplier LEFT JOIN a ON a.i = s_suppkey LEFT JOIN x ON a.j = x.i GROUP BY 1""")
def spmv(spark, sf):
    return products.matvec(src.supply_matrix(spark, sf), src.part_sizes(spark, sf)).df


@query("spmv_t", with_(SUPPLY, NATIONS) + """
SELECT p_partkey AS i, coalesce(sum(a.v * y.v), 0) AS v
FROM part LEFT JOIN a ON a.j = p_partkey LEFT JOIN y ON a.i = y.i GROUP BY 1""")
def spmv_t(spark, sf):
    return products.matvec(src.supply_matrix(spark, sf), src.supplier_nations(spark, sf), trans=True).df


@query("spmv_axpby", with_(SUPPLY, SIZES, NATIONS) + """,
p AS (SELECT a.i, sum(a.v * x.v) AS s FROM a JOIN x ON a.j = x.i GROUP BY 1)
SELECT y.i, 2 * coalesce(s, 0) + 3 * y.v AS v FROM y LEFT JOIN p ON p.i = y.i""")
def spmv_axpby(spark, sf):
    a, x, y = src.supply_matrix(spark, sf), src.part_sizes(spark, sf), src.supplier_nations(spark, sf)
    return products.matvec(a, x, alpha=2.0, beta=3.0, x=y).df


@query("spmv_sym", with_(STIFF, LOAD) + "SELECT k.i, sum(k.v * b.v) AS v FROM k JOIN b ON k.j = b.i GROUP BY 1")
def spmv_sym(spark, sf):
    half = structure.to_symmetric(src.stiffness(spark, sf))
    return products.matvec(half, src.customer_load(spark, sf)).df


_SIZE_CLASSES = "c AS (SELECT p_partkey AS i, CAST(p_size AS BIGINT) AS j, CAST(1 AS DOUBLE) AS v FROM part)"


@query("spgemm", with_(SUPPLY, _SIZE_CLASSES) + """
SELECT a.i, c.j, sum(a.v * c.v) AS v FROM a JOIN c ON a.j = c.i GROUP BY 1, 2""")
def spgemm(spark, sf):
    return products.matmul(src.supply_matrix(spark, sf), src.part_size_classes(spark, sf)).df


@query("spgemm_t", with_(SUPPLY, SUPPLIER_NATION) + """
SELECT a.j AS i, p.j, sum(a.v * p.v) AS v FROM a JOIN p ON a.i = p.i GROUP BY 1, 2""")
def spgemm_t(spark, sf):
    a, p = src.supply_matrix(spark, sf), src.supplier_nation_classes(spark, sf)
    return products.matmul(a, p, trans_a=True).df


@query("spgemm_square", with_(STIFF) + """
SELECT l.i, r.j, sum(l.v * r.v) AS v FROM k l JOIN k r ON l.j = r.i GROUP BY 1, 2""")
def spgemm_square(spark, sf):
    k = src.stiffness(spark, sf)
    return products.matmul(k, k).df


_PTAP = with_(STIFF, CUSTOMER_NATION) + """
SELECT l.j AS i, r.j, sum(l.v * k.v * r.v) AS v
FROM k JOIN p l ON k.i = l.i JOIN p r ON k.j = r.i"""


@query("ptap", _PTAP + " GROUP BY 1, 2")
def ptap(spark, sf):
    return products.ptap(src.stiffness(spark, sf), src.customer_nation_classes(spark, sf)).df


@query("ptap_sym", _PTAP + " WHERE l.j <= r.j GROUP BY 1, 2")
def ptap_sym(spark, sf):
    half = structure.to_symmetric(src.stiffness(spark, sf))
    return products.ptap(half, src.customer_nation_classes(spark, sf)).df


@query("papt", _PTAP + " GROUP BY 1, 2")
def papt(spark, sf):
    p = structure.transpose(src.customer_nation_classes(spark, sf))
    return products.papt(src.stiffness(spark, sf), p).df


@query("papt_sym", _PTAP + " WHERE l.j <= r.j GROUP BY 1, 2")
def papt_sym(spark, sf):
    half = structure.to_symmetric(src.stiffness(spark, sf))
    return products.papt(half, structure.transpose(src.customer_nation_classes(spark, sf))).df


def _part_features(spark, sf) -> DenseMatrix:
    """part × (size, 1, key mod 10): a tall dense matrix."""
    cols = F.array(F.col("p_size").cast("double"), F.lit(1.0), (F.col("p_partkey") % 10).cast("double"))
    df = src.table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.posexplode(cols).alias("j", "v"))
    return DenseMatrix(df.select("i", F.col("j").cast("bigint").alias("j"), "v"), src.parts(spark, sf), 3)


_FEATURES = """
f AS (
  SELECT p_partkey AS i, CAST(0 AS BIGINT) AS j, CAST(p_size AS DOUBLE) AS v FROM part
  UNION ALL SELECT p_partkey, 1, 1 FROM part
  UNION ALL SELECT p_partkey, 2, CAST(p_partkey % 10 AS DOUBLE) FROM part)
"""


@query("sparse_dense", with_(SUPPLY, _FEATURES) + """,
s AS (SELECT a.i, f.j, sum(a.v * f.v) AS v FROM a JOIN f ON a.j = f.i GROUP BY 1, 2),
grid AS (SELECT s_suppkey AS i, c AS j FROM supplier, range(3) r(c))
SELECT g.i, g.j, coalesce(s.v, 0) AS v FROM grid g LEFT JOIN s ON g.i = s.i AND g.j = s.j""")
def sparse_dense(spark, sf):
    return products.sparse_dense(src.supply_matrix(spark, sf), _part_features(spark, sf)).df


@query("sparse_dense_t", with_(SUPPLY, SUPPLIER_NATION) + """,
f AS (SELECT s_suppkey AS i, CAST(0 AS BIGINT) AS j, CAST(s_nationkey AS DOUBLE) AS v FROM supplier
      UNION ALL SELECT s_suppkey, 1, 1 FROM supplier),
s AS (SELECT a.j AS i, f.j, sum(a.v * f.v) AS v FROM a JOIN f ON a.i = f.i GROUP BY 1, 2),
grid AS (SELECT p_partkey AS i, c AS j FROM part, range(2) r(c))
SELECT g.i, g.j, coalesce(s.v, 0) AS v FROM grid g LEFT JOIN s ON g.i = s.i AND g.j = s.j""")
def sparse_dense_t(spark, sf):
    cols = F.array(F.col("s_nationkey").cast("double"), F.lit(1.0))
    df = src.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), F.posexplode(cols).alias("j", "v"))
    dense = DenseMatrix(df.select("i", F.col("j").cast("bigint").alias("j"), "v"), src.suppliers(spark, sf), 2)
    return products.sparse_dense(src.supply_matrix(spark, sf), dense, trans_a=True).df


@query("dense_product", with_(_FEATURES) + """
SELECT l.j AS i, r.j, sum(l.v * r.v) AS v FROM f l JOIN f r ON l.i = r.i GROUP BY 1, 2""")
def dense_product(spark, sf):
    f = _part_features(spark, sf)
    return products.dense_product(f, f, trans_a=True).df


@query("dense_gram", with_(CELLS) + """
SELECT l.j AS i, r.j, round(sum(l.v * r.v), 6) + 0 AS v FROM e l JOIN e r ON l.i = r.i GROUP BY 1, 2""")
def dense_gram(spark, sf):
    e = src.embedding_matrix(spark, sf)
    g = products.dense_product(e, e, trans_a=True).df
    return g.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


_CUSTOMER_FEATURES = """
f AS (
  SELECT c_custkey AS i, CAST(0 AS BIGINT) AS j, CAST(c_nationkey AS DOUBLE) AS v FROM customer
  UNION ALL SELECT c_custkey, 1, 1 FROM customer)
"""


def _customer_features(spark, sf) -> DenseMatrix:
    cols = F.array(F.col("c_nationkey").cast("double"), F.lit(1.0))
    df = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.posexplode(cols).alias("j", "v"))
    return DenseMatrix(df.select("i", F.col("j").cast("bigint").alias("j"), "v"), src.customers(spark, sf), 2)


_DENSE_TRIPLE = with_(STIFF, _CUSTOMER_FEATURES) + """
SELECT l.j AS i, r.j, sum(l.v * k.v * r.v) AS v FROM k JOIN f l ON k.i = l.i JOIN f r ON k.j = r.i GROUP BY 1, 2"""


@query("dense_ptap", _DENSE_TRIPLE)
def dense_ptap(spark, sf):
    return products.dense_ptap(src.stiffness(spark, sf), _customer_features(spark, sf)).df


@query("dense_papt", _DENSE_TRIPLE)
def dense_papt(spark, sf):
    f = _customer_features(spark, sf)
    flipped = f.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return products.dense_papt(src.stiffness(spark, sf), DenseMatrix(flipped, f.ncols, f.nrows)).df


@query("diag_vec", with_(STIFF, LOAD) + """
SELECT b.i, 2 * k.v * b.v + 3 * b.v AS v FROM k JOIN b ON k.i = b.i WHERE k.i = k.j""")
def diag_vec(spark, sf):
    b = src.customer_load(spark, sf)
    return products.diagonal_times_vector(structure.diagonal(src.stiffness(spark, sf)), b, 2.0, 3.0, b).df


# -- structure --------------------------------------------------------------


@query("transpose", with_(SUPPLY) + "SELECT j AS i, i AS j, v FROM a")
def transpose(spark, sf):
    return structure.transpose(src.supply_matrix(spark, sf)).df


@query("prune", with_(SUPPLY) + "SELECT i, j, v FROM a WHERE abs(v) > 25")
def prune(spark, sf):
    return structure.prune(src.supply_matrix(spark, sf), 25.0).df


@query("split_l", with_(STIFF) + "SELECT i, j, v FROM k WHERE j < i")
def split_l(spark, sf):
    return structure.strict_lower(src.stiffness(spark, sf)).df


@query("split_d", with_(LAPLACE) + """
SELECT c_custkey AS i, coalesce(v, 0) AS v FROM customer LEFT JOIN lap ON i = c_custkey AND j = c_custkey""")
def split_d(spark, sf):
    return structure.split_ldu(src.laplacian(spark, sf))[1].df


@query("split_u", with_(STIFF) + "SELECT i, j, v FROM k WHERE j > i")
def split_u(spark, sf):
    return structure.strict_upper(src.stiffness(spark, sf)).df


@query("tri_upper", with_(STIFF) + "SELECT i, j, v FROM k WHERE j >= i")
def tri_upper(spark, sf):
    return structure.upper_triangle(src.stiffness(spark, sf)).df


@query("tri_lower", with_(STIFF) + "SELECT i, j, v FROM k WHERE j <= i")
def tri_lower(spark, sf):
    return structure.lower_triangle(src.stiffness(spark, sf)).df


@query("sym_expand", with_(STIFF) + "SELECT i, j, v FROM k")
def sym_expand(spark, sf):
    return structure.to_full(structure.to_symmetric(src.stiffness(spark, sf))).df


@query("block", with_(SUPPLY) + """,
m AS (SELECT max(s_suppkey) + 1 AS r FROM supplier), n AS (SELECT max(p_partkey) + 1 AS c FROM part)
SELECT i - r // 4 AS i, j - c // 4 AS j, v FROM a, m, n
WHERE i >= r // 4 AND i < r // 4 + r // 2 AND j >= c // 4 AND j < c // 4 + c // 2""")
def block(spark, sf):
    a = src.supply_matrix(spark, sf)
    return structure.block(a, a.nrows // 4, a.ncols // 4, a.nrows // 2, a.ncols // 2).df


@query("diag", with_(STIFF) + "SELECT i, v FROM k WHERE i = j")
def diag(spark, sf):
    return structure.diagonal(src.stiffness(spark, sf)).df


@query("diag_inv", with_(LAPLACE) + """
SELECT c_custkey AS i, CASE WHEN coalesce(v, 0) = 0 THEN 1 ELSE 1 / v END AS v
FROM customer LEFT JOIN lap ON i = c_custkey AND j = c_custkey""")
def diag_inv(spark, sf):
    return structure.diagonal(src.laplacian(spark, sf), invert=True).df


@query("diag_pos", with_(STIFF) + """,
o AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS pos FROM k)
SELECT i, CAST(pos AS BIGINT) AS pos FROM o WHERE i = j""")
def diag_pos(spark, sf):
    return structure.diagonal_positions(Workspace(spark), src.stiffness(spark, sf))


@query("diag_complete", with_(LAPLACE) + """
SELECT (SELECT count(*) FROM customer) AS n, count(*) AS stored,
       count(*) = (SELECT count(*) FROM customer) AS complete FROM lap WHERE i = j""")
def diag_complete(spark, sf):
    return structure.diagonal_complete(src.laplacian(spark, sf))


@query("adjacency", with_(STIFF) + "SELECT i AS src, j AS dst FROM k WHERE i <> j")
def adjacency(spark, sf):
    return structure.without_self_loops(src.stiffness(spark, sf))


@query("row_pointer", with_(SUPPLY) + """,
c AS (SELECT i + 1 AS i, count(*) AS n FROM a GROUP BY 1),
r AS (SELECT unnest(range(0, (SELECT max(s_suppkey) + 2 FROM supplier))) AS i)
SELECT r.i, CAST(1 + sum(coalesce(n, 0)) OVER (ORDER BY r.i) AS BIGINT) AS ptr FROM r LEFT JOIN c ON r.i = c.i""")
def row_pointer(spark, sf):
    return structure.row_pointer(Workspace(spark), src.supply_matrix(spark, sf), base=1)


@query("permuted_row_pointer", with_(STIFF, RANKED) + """,
c AS (SELECT new_id + 1 AS i, count(*) AS n FROM k JOIN perm ON k.i = old_id GROUP BY 1),
r AS (SELECT unnest(range(0, (SELECT max(c_custkey) + 2 FROM customer))) AS i)
SELECT r.i, CAST(sum(coalesce(n, 0)) OVER (ORDER BY r.i) AS BIGINT) AS ptr FROM r LEFT JOIN c ON r.i = c.i""")
def permuted_row_pointer(spark, sf):
    return structure.permuted_row_pointer(Workspace(spark), src.stiffness(spark, sf), balance_order(spark, sf))


@query("permute", with_(STIFF, RANKED) + """
SELECT r.new_id AS i, c.new_id AS j, v FROM k JOIN perm r ON k.i = r.old_id JOIN perm c ON k.j = c.old_id""")
def permute(spark, sf):
    p = balance_order(spark, sf)
    return structure.permute(src.stiffness(spark, sf), p, p).df


@query("permute_row", with_(STIFF, RANKED) + "SELECT new_id AS i, j, v FROM k JOIN perm ON k.i = old_id")
def permute_row(spark, sf):
    return structure.permute(src.stiffness(spark, sf), balance_order(spark, sf), None).df


@query("sym_permute", with_(STIFF, RANKED) + """
SELECT least(r.new_id, c.new_id) AS i, greatest(r.new_id, c.new_id) AS j, v
FROM k JOIN perm r ON k.i = r.old_id JOIN perm c ON k.j = c.old_id WHERE k.i <= k.j""")
def sym_permute(spark, sf):
    return structure.symmetric_permute(src.stiffness(spark, sf), balance_order(spark, sf)).df


@query("permute_vec", with_(LOAD, RANKED) + "SELECT new_id AS i, v FROM b JOIN perm ON b.i = old_id")
def permute_vec(spark, sf):
    return structure.permute_vector(src.customer_load(spark, sf), balance_order(spark, sf)).df


@query("inv_perm", with_(RANKED) + "SELECT old_id AS new_id, new_id AS old_id FROM perm")
def inv_perm(spark, sf):
    return balance_order(spark, sf).inverse().df.select("new_id", "old_id")


@query("is_perm", "SELECT count(*) AS n, true AS valid FROM customer")
def is_perm(spark, sf):
    return structure.permutation_check(balance_order(spark, sf))


@query("permute_round_trip", with_(STIFF) + "SELECT i, j, v FROM k")
def permute_round_trip(spark, sf):
    p = balance_order(spark, sf)
    moved = structure.permute(src.stiffness(spark, sf), p, p)
    return structure.permute(moved, p.inverse(), p.inverse()).df


@query("dtad", with_(STIFF, LOAD) + """
SELECT k.i, k.j, l.v * k.v * r.v AS v FROM k JOIN b l ON k.i = l.i JOIN b r ON k.j = r.i""")
def dtad(spark, sf):
    return structure.scale_two_sided(src.stiffness(spark, sf), src.customer_load(spark, sf)).df


@query("base_shift", with_(SUPPLY) + "SELECT i + 1 AS i, j + 1 AS j, v FROM a")
def base_shift(spark, sf):
    return structure.shift_base(src.supply_matrix(spark, sf), 1)


@query("dense_to_sparse_t", with_(CELLS) + "SELECT j AS i, i AS j, v FROM e")
def dense_to_sparse_t(spark, sf):
    return structure.dense_to_sparse_transposed(src.embedding_matrix(spark, sf)).df


@query("threshold_columns", with_(SUPPLY) + """,
m AS (SELECT j, max(abs(v)) AS p FROM a GROUP BY 1)
SELECT i, a.j, round(v / p, 6) AS v FROM a JOIN m ON a.j = m.j WHERE abs(v / p) > 0.25""")
def threshold_columns(spark, sf):
    kept = structure.threshold_columns(src.supply_matrix(spark, sf).df, ["j"], 0.25)
    return kept.select("i", "j", F.round("v", 6).alias("v"))


@query("gnuplot", with_(STIFF) + "SELECT j || ' ' || (-i) AS line FROM k")
def gnuplot(spark, sf):
    return sinks.gnuplot_lines(src.stiffness(spark, sf))


@query("svg_rects", with_(STIFF) + """
SELECT '<rect x="' || j || '" y="' || i || '" width="1" height="1"/>' AS line FROM k""")
def svg_rects(spark, sf):
    return sinks.svg_rects(src.stiffness(spark, sf))


# -- generators keyed by the tables -----------------------------------------


@query("identity", "SELECT c_custkey AS i, c_custkey AS j, CAST(2.5 AS DOUBLE) AS v FROM customer")
def identity(spark, sf):
    return generators.scaled_identity(spark, src.customers(spark, sf), 2.5).df


@query("random_sparse", """
SELECT c_custkey AS i, CAST(7 AS BIGINT) AS entries, CAST(7 AS BIGINT) AS columns, true AS in_range FROM customer""")
def random_sparse(spark, sf):
    rows = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("i"))
    n = src.customers(spark, sf)
    drawn = generators.random_values(generators.random_pattern(rows, n, 7, seed=11), seed=12)
    inside = (F.col("j") >= 0) & (F.col("j") < n) & (F.col("v") >= 0.0) & (F.col("v") < 1.0)
    return drawn.df.groupBy("i").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("j").alias("columns"), F.bool_and(inside).alias("in_range")
    )


@query("sample_ordered", "SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS ids, CAST(100 AS BIGINT) AS known")
def sample_ordered(spark, sf):
    ids = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    drawn = generators.sample_ordered(ids, 100, seed=5)
    return drawn.join(ids.withColumn("k", F.lit(1)), "id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count("k").alias("known")
    )


@query("random_permutation", "SELECT count(*) AS n, true AS valid FROM customer")
def random_permutation(spark, sf):
    ids = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return structure.permutation_check(
        generators.random_permutation(Workspace(spark), ids, src.customers(spark, sf), seed=3)
    )


# -- sums -------------------------------------------------------------------

_FLAGS = """
r AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
n AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem
      WHERE l_returnflag IS DISTINCT FROM 'R' GROUP BY 1, 2)
"""


@query("sparse_sum", with_(_FLAGS) + """
SELECT i, j, sum(v) AS v FROM (SELECT i, j, -1 * v AS v FROM r UNION ALL SELECT i, j, v FROM n) GROUP BY 1, 2""")
def sparse_sum(spark, sf):
    """What was kept minus what was returned; every line is in one of the two."""
    returned = src.supply_matrix(spark, sf, "l_returnflag <=> 'R'")
    kept = src.supply_matrix(spark, sf, "NOT l_returnflag <=> 'R'")
    return sums.add(returned, kept, -1.0).df


@query("sparse_sum_sym", with_(STIFF) + """
SELECT i, j, CASE WHEN i = j THEN 2 * v + 1 ELSE 2 * v END AS v FROM k WHERE i <= j""")
def sparse_sum_sym(spark, sf):
    half = structure.to_symmetric(src.stiffness(spark, sf))
    one = generators.scaled_identity(spark, half.nrows).with_entries
    identity_half = one(generators.scaled_identity(spark, half.nrows).df, structure="sym_upper")
    return sums.add(half, identity_half, 2.0).df


@query("cancel_and_prune", with_(SUPPLY) + """
SELECT count(*) AS stored, CAST(0 AS BIGINT) AS pruned FROM a""")
def cancel_and_prune(spark, sf):
    a = src.supply_matrix(spark, sf)
    gone = sums.add(a, a, -1.0)
    kept = F.count_if(F.abs("v") > 1e-16)
    return gone.df.agg(F.count(F.lit(1)).alias("stored"), kept.alias("pruned"))


_LINKS_UPPER = ARCS + ", t AS (SELECT a AS i, b AS j FROM links UNION ALL SELECT id, id FROM degs WHERE deg > 1)"


def _one_sided(spark, sf) -> SparseMatrix:
    """Links in one direction, and a self loop for every customer with two or more."""
    links = src.trade_links(spark, sf).select(F.col("src").alias("i"), F.col("dst").alias("j"))
    loops = (
        src.trade_graph(spark, sf).edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("src").alias("i"), F.col("src").alias("j"))
    )
    n = src.customers(spark, sf)
    return SparseMatrix(links.union(loops).withColumn("v", F.lit(1.0)), n, n)


@query("aat_pattern", with_(_LINKS_UPPER) + "SELECT i, j FROM t UNION SELECT j, i FROM t")
def aat_pattern(spark, sf):
    return sums.union_pattern(_one_sided(spark, sf))


@query("aat_pattern_offdiag", with_(_LINKS_UPPER) + """
SELECT i, j FROM t WHERE i <> j UNION SELECT j, i FROM t WHERE i <> j""")
def aat_pattern_offdiag(spark, sf):
    return sums.union_pattern(_one_sided(spark, sf), keep_diagonal=False)


@query("aat_counts", with_(_LINKS_UPPER) + """,
u AS (SELECT i, j FROM t UNION SELECT j, i FROM t)
SELECT c_custkey AS i, count(u.i) AS n FROM customer LEFT JOIN u ON u.i = c_custkey GROUP BY 1""")
def aat_counts(spark, sf):
    return sums.union_pattern_counts(_one_sided(spark, sf))


@query("merge_levels", """
SELECT l_partkey AS col, CAST(min(l_linenumber + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS INTEGER) AS level
FROM lineitem GROUP BY 1""")
def merge_levels(spark, sf):
    lines = src.table(spark, sf, "lineitem")
    level = F.col("l_linenumber").cast("int")
    one = lines.where("l_returnflag <=> 'R'").select(F.col("l_partkey").alias("col"), level.alias("level"))
    two = lines.where("NOT l_returnflag <=> 'R'").select(F.col("l_partkey").alias("col"), (level + 1).alias("level"))
    return sums.merge_levels(one, two, ["col"])


# -- statistics -------------------------------------------------------------


@query("degree", with_(ARCS) + "SELECT id, deg FROM degs")
def degree(spark, sf):
    return stats.degree(src.trade_adjacency(spark, sf))


@query("min_degree", with_(ARCS) + "SELECT id, deg FROM degs ORDER BY deg, id LIMIT 1")
def min_degree(spark, sf):
    return stats.min_degree(stats.degree(src.trade_adjacency(spark, sf)))


@query("window_min_degree", with_(ARCS) + """,
w AS (SELECT id, min({'d': deg, 'k': id}) OVER (ORDER BY id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM degs)
SELECT id, m.k AS min_id, m.d AS min_deg FROM w""")
def window_min_degree(spark, sf):
    return stats.sliding_min_degree(stats.degree(src.trade_adjacency(spark, sf)))


@query("shape", with_(SUPPLY) + """
SELECT (SELECT count(*) FROM supplier) AS nrows, (SELECT count(*) FROM part) AS ncols,
       count(*) AS nnz, count(*) // (SELECT count(*) FROM supplier) AS avg_nnz FROM a""")
def shape(spark, sf):
    return stats.shape(src.supply_matrix(spark, sf))


@query("max_nnz", with_(SUPPLY) + "SELECT max(n) AS max_nnz FROM (SELECT count(*) AS n FROM a GROUP BY i)")
def max_nnz(spark, sf):
    return stats.max_nnz(src.supply_matrix(spark, sf))


@query("row_spread", with_(STIFF) + "SELECT max(s) AS row_spread FROM (SELECT max(j) - min(j) AS s FROM k GROUP BY i)")
def row_spread(spark, sf):
    return stats.row_spread(src.stiffness(spark, sf))


@query("bandwidth", with_(STIFF) + "SELECT max(abs(i - j)) AS bandwidth FROM k")
def bandwidth(spark, sf):
    return stats.bandwidth(src.stiffness(spark, sf))


_ROW_SCALE = with_(STIFF) + "SELECT i, round(1 / sqrt(sqrt(sum(v * v))), 6) AS v FROM k GROUP BY 1"


@query("row_scaling", _ROW_SCALE)
def row_scaling(spark, sf):
    return stats.row_scaling(src.stiffness(spark, sf)).df.select("i", F.round("v", 6).alias("v"))


@query("row_scaling_sym", _ROW_SCALE)
def row_scaling_sym(spark, sf):
    half = structure.to_symmetric(src.stiffness(spark, sf))
    return stats.row_scaling(half).df.select("i", F.round("v", 6).alias("v"))


@query("valid_csr", """
WITH c AS (SELECT l_suppkey AS i, l_linenumber AS j, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(CASE WHEN j >= 5 THEN n ELSE 0 END) AS BIGINT) AS out_of_range,
       CAST(sum(n - 1) AS BIGINT) AS duplicates, false AS valid FROM c""")
def valid_csr(spark, sf):
    """Lines keyed by (supplier, line number) as a five-column matrix: invalid twice over."""
    df = src.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j"), F.col("l_quantity").alias("v")
    )
    return stats.validity(SparseMatrix(df, src.suppliers(spark, sf), 5))


@query("structure_check", with_(STIFF) + """
SELECT CAST(0 AS BIGINT) AS out_of_range, CAST(0 AS BIGINT) AS duplicates, count(*) AS wrong_side FROM k WHERE j > i""")
def structure_check(spark, sf):
    k = src.stiffness(spark, sf)
    return stats.structure_check(k.with_entries(k.df, structure="lower"))


@query("symmetry", with_(STIFF) + """,
m AS (SELECT l.v AS v, r.v AS w FROM k l LEFT JOIN k r ON l.i = r.j AND l.j = r.i)
SELECT count(*) FILTER (w IS NULL) AS pattern_misses, count(*) FILTER (w > v OR w < v) AS value_misses,
       count(*) FILTER (w IS NULL OR w <> v) = 0 AS symmetric FROM m""")
def symmetry(spark, sf):
    return stats.symmetry(src.stiffness(spark, sf))


@query("asymmetry", with_(_LINKS_UPPER) + """
SELECT count(*) FILTER (i <> j) AS pattern_misses, CAST(0 AS BIGINT) AS value_misses, false AS symmetric FROM t""")
def asymmetry(spark, sf):
    return stats.symmetry(_one_sided(spark, sf))


@query("vec_norm", with_(LOAD) + "SELECT round(sqrt(sum(v * v)), 6) AS norm FROM b")
def vec_norm(spark, sf):
    return stats.vector_norm(src.customer_load(spark, sf)).select(F.round("norm", 6).alias("norm"))


@query("vec_dot", with_(SIZES) + "SELECT sum(v * v) AS dot FROM x")
def vec_dot(spark, sf):
    x = src.part_sizes(spark, sf)
    return stats.vector_dot(x, x)


@query("vec_axpy", with_(SIZES) + "SELECT i, 3 * v + v AS v FROM x")
def vec_axpy(spark, sf):
    x = src.part_sizes(spark, sf)
    return stats.axpy(3.0, x, x).df


@query("vec_max_abs", with_(SIZES) + "SELECT max(abs(-2 * v)) AS max_abs FROM x")
def vec_max_abs(spark, sf):
    return stats.max_abs(stats.scale_vector(-2.0, src.part_sizes(spark, sf)))


@query("min_diag", with_(STIFF) + "SELECT min(v) AS min_diag FROM k WHERE i = j")
def min_diag(spark, sf):
    return stats.min_diagonal(src.stiffness(spark, sf))


@query("topk_row", with_(SUPPLY) + """,
r AS (SELECT i, j, v, row_number() OVER (PARTITION BY i ORDER BY abs(v) DESC, j) AS n FROM a)
SELECT i, j, v FROM r WHERE n <= 5""")
def topk_row(spark, sf):
    return stats.top_entries(src.supply_matrix(spark, sf), 5).df


@query("row_segments", with_(SUPPLY) + "SELECT i, sum(v) AS s, count(*) AS n FROM a GROUP BY 1")
def row_segments(spark, sf):
    return stats.row_segments(src.supply_matrix(spark, sf))


@query("sorted_entries", with_(SUPPLY) + """
SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS BIGINT) AS pos, i, j, v FROM a""")
def sorted_entries(spark, sf):
    return stats.sorted_entries(Workspace(spark), src.supply_matrix(spark, sf))


@query("even_partition", """
WITH n AS (SELECT max(c_custkey) + 1 AS n FROM customer), t AS (SELECT unnest(range(7)) AS part),
f AS (SELECT part, part * (n // 7) + least(part, n % 7) AS first, (n // 7) + (part < n % 7)::INT AS size FROM t, n)
SELECT part, first, first + size AS past FROM f""")
def even_partition(spark, sf):
    return stats.even_partition(src.customers(spark, sf), 7, spark)


@query("weighted_partition", with_(STIFF) + """,
w AS (SELECT i AS id, count(*) AS w FROM k GROUP BY 1),
s AS (SELECT id, coalesce(sum(w) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w
      UNION ALL SELECT max(id) + 1, sum(w) FROM w),
g AS (SELECT sum(w) // 8 AS q, sum(w) % 8 AS r FROM w),
t AS (SELECT p AS part, CASE WHEN p >= r THEN p * q + r ELSE p * (q + 1) END AS target FROM range(9) z(p), g),
f AS (SELECT part, (SELECT min(id) FROM s WHERE before >= target) AS first FROM t WHERE part BETWEEN 1 AND 7
      UNION ALL SELECT 0, 0 UNION ALL SELECT 8, (SELECT max(id) + 1 FROM w))
SELECT l.part, l.first, r.first AS past FROM f l JOIN f r ON r.part = l.part + 1""")
def weighted_partition(spark, sf):
    weights = stats.degree(src.stiffness(spark, sf)).withColumnRenamed("deg", "w")
    return stats.weighted_partition(Workspace(spark), weights, 8)

"""Common table expressions the SQL counterparts are built from."""

SUPPLY = "a AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"

SIZES = "x AS (SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS v FROM part)"

NATIONS = "y AS (SELECT s_suppkey AS i, CAST(s_nationkey + 1 AS DOUBLE) AS v FROM supplier)"

ARCS = """
sales AS (
  SELECT DISTINCT o_custkey AS c, l_partkey AS p, CAST(l_shipdate AS DATE) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
highest AS (SELECT p, d, max(c) AS hi FROM sales GROUP BY 1, 2),
links AS (SELECT DISTINCT c AS a, hi AS b FROM sales JOIN highest USING (p, d) WHERE c <> hi),
arcs AS (SELECT a AS src, b AS dst FROM links UNION ALL SELECT b, a FROM links),
degs AS (SELECT c_custkey AS id, count(src) AS deg FROM customer LEFT JOIN arcs ON src = c_custkey GROUP BY 1)
"""

LAPLACE = ARCS + """,
lap AS (
  SELECT src AS i, dst AS j, CAST(-1 AS DOUBLE) AS v FROM arcs
  UNION ALL SELECT id, id, CAST(deg AS DOUBLE) FROM degs WHERE deg > 0)
"""

STIFF = ARCS + """,
k AS (
  SELECT src AS i, dst AS j, CAST(-1 AS DOUBLE) AS v FROM arcs
  UNION ALL SELECT id, id, CAST(deg + 1 AS DOUBLE) FROM degs)
"""

LOAD = "b AS (SELECT c_custkey AS i, CAST(c_custkey % 7 + 1 AS DOUBLE) AS v FROM customer)"

RANKED = """
perm AS (
  SELECT CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS BIGINT) AS new_id,
         c_custkey AS old_id FROM customer)
"""

CUSTOMER_NATION = "p AS (SELECT c_custkey AS i, CAST(c_nationkey AS BIGINT) AS j, CAST(1 AS DOUBLE) AS v FROM customer)"

SUPPLIER_NATION = "p AS (SELECT s_suppkey AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(1 AS DOUBLE) AS v FROM supplier)"

CELLS = """
e AS (
  SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(CAST(embedding AS DOUBLE[])) AS v
  FROM embeddings)
"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(c.strip() for c in ctes) + "\n"

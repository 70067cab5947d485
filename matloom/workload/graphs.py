"""Traversal, component, ordering and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matloom.model import Graph
from matloom.operators import disjoint, dissection, graph, ordering, stats, structure
from matloom.runtime import Workspace
from matloom.sources import tables as src
from matloom.workload.registry import query
from matloom.workload.sqltext import ARCS, with_

_SUPPLY_GRAPH = """
m AS (SELECT max(s_suppkey) + 1 AS m FROM supplier),
half AS (SELECT DISTINCT l_suppkey AS a, l_partkey + m AS b FROM lineitem, m),
sarcs AS (SELECT a AS src, b AS dst FROM half UNION ALL SELECT b, a FROM half),
verts AS (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT p_partkey + m FROM part, m),
"""

_WALK = "WITH RECURSIVE " + _SUPPLY_GRAPH + """
found(id, level) USING KEY (id) AS (
  SELECT CAST(0 AS BIGINT), 0
  UNION
  SELECT dst, min(w.level) + 1
  FROM found w JOIN sarcs ON src = w.id LEFT JOIN recurring.found old ON old.id = dst
  WHERE old.id IS NULL GROUP BY dst)
"""


@query("bfs", _WALK + "SELECT verts.id, coalesce(level, -1) AS level FROM verts LEFT JOIN found ON verts.id = found.id")
def bfs(spark, sf):
    return graph.bfs_levels(Workspace(spark), src.supply_graph(spark, sf), 0)


@query("bfs_shape", _WALK + """,
sizes AS (SELECT level, count(*) AS n FROM found GROUP BY 1)
SELECT count(*) AS height, max(n) AS width, arg_max(n, level) AS last FROM sizes""")
def bfs_shape(spark, sf):
    """Number of levels, widest level, size of the last level."""
    sizes = graph.bfs(Workspace(spark), src.supply_graph(spark, sf), 0).reached.groupBy("level").agg(
        F.count(F.lit(1)).alias("n")
    )
    return sizes.agg(
        F.count(F.lit(1)).alias("height"), F.max("n").alias("width"), F.max_by("n", "level").alias("last")
    )


@query("bfs_capped", _WALK + """,
sizes AS (SELECT level, count(*) AS n FROM found GROUP BY 1),
stop AS (SELECT min(level) AS s FROM sizes, (SELECT count(*) AS c FROM supplier) WHERE n >= c)
SELECT id, level FROM found, stop WHERE level <= s""")
def bfs_capped(spark, sf):
    """Stops at the first level as large as the supplier table."""
    cap = src.table(spark, sf, "supplier").count()
    run = graph.bfs(Workspace(spark), src.supply_graph(spark, sf), 0, cap=cap)
    return run.reached.select("id", "level")


_CLOSURE = "WITH RECURSIVE " + ARCS.strip() + """,
reach AS (SELECT c_custkey AS id, c_custkey AS other FROM customer
          UNION SELECT id, dst FROM reach JOIN arcs ON src = other),
comps AS (SELECT id, max(other) AS comp FROM reach GROUP BY 1)
"""


@query("components", _CLOSURE + "SELECT id, comp FROM comps")
def components(spark, sf):
    return graph.components(Workspace(spark), src.trade_graph(spark, sf))


@query("component_batches", _CLOSURE + "SELECT id, comp FROM comps")
def component_batches(spark, sf):
    """The links in three batches of which one is sent twice."""
    ws, g = Workspace(spark), src.trade_graph(spark, sf)
    sets = disjoint.DisjointSets(ws, ws.new_path("sets"))
    links = ws.save(g.edges.toDF("a", "b")).df
    for k in (0, 1, 1, 2):
        sets.unite(links.where((F.col("a") + F.col("b")) % 3 == k), f"part{k}")
    return sets.find(g.vertices).withColumnRenamed("root", "comp")


@query("component_count", _CLOSURE + "SELECT count(DISTINCT comp) AS components FROM comps")
def component_count(spark, sf):
    return graph.component_count(components(spark, sf))


@query("component_stats", _CLOSURE + """,
s AS (SELECT comp, count(*) AS size FROM comps GROUP BY 1)
SELECT comp, size, CAST(sum(size) OVER (ORDER BY comp) - size AS BIGINT) AS start FROM s""")
def component_stats(spark, sf):
    return graph.component_stats(Workspace(spark), components(spark, sf))


@query("component_members", _CLOSURE + """
SELECT comp, id, CAST(row_number() OVER (ORDER BY comp, id) - 1 AS BIGINT) AS pos,
       CAST(row_number() OVER (PARTITION BY comp ORDER BY id) - 1 AS BIGINT) AS rank FROM comps""")
def component_members(spark, sf):
    return graph.component_members(Workspace(spark), components(spark, sf))


@query("same_component", _CLOSURE + """
SELECT DISTINCT x.o_custkey AS a, y.o_custkey AS b, ca.comp = cb.comp AS same
FROM orders x JOIN orders y ON y.o_orderkey = x.o_orderkey + 1
JOIN comps ca ON ca.id = x.o_custkey JOIN comps cb ON cb.id = y.o_custkey""")
def same_component(spark, sf):
    """Buyers of consecutive orders: are they linked at all?"""
    o = src.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("b"))
    pairs = o.join(nxt, "o_orderkey").select(F.col("o_custkey").alias("a"), "b").distinct()
    return graph.same_component(components(spark, sf), pairs)


@query("quotient_nodes", with_(ARCS) + "SELECT id, deg AS degree, CAST(1 AS BIGINT) AS weight FROM degs")
def quotient_nodes(spark, sf):
    return graph.quotient_graph(Graph.of(src.stiffness(spark, sf)))[0]


@query("quotient_neighbours", with_(ARCS) + "SELECT src AS id, dst AS nbr FROM arcs")
def quotient_neighbours(spark, sf):
    return graph.quotient_graph(Graph.of(src.stiffness(spark, sf)))[1]


def _levels_sql(side: str) -> str:
    return "WITH RECURSIVE " + ARCS.strip() + f""",
deps AS (SELECT src AS id, dst AS dep FROM arcs WHERE dst {side} src),
walk AS (SELECT c_custkey AS id, 0 AS level FROM customer
         UNION SELECT deps.id, level + 1 FROM walk JOIN deps ON deps.dep = walk.id),
lv AS (SELECT id, max(level) AS level FROM walk GROUP BY 1)
"""


def _schedule(spark, sf, side: str):
    k = src.stiffness(spark, sf)
    ws = Workspace(spark)
    return ws, graph.level_schedule(ws, graph.triangle_needs(k.df, side), spark.range(k.nrows))


@query("level_sort", _levels_sql("<") + "SELECT id, level FROM lv")
def level_sort(spark, sf):
    return _schedule(spark, sf, "lower")[1][0]


@query("level_sort_upper", _levels_sql(">") + "SELECT id, level FROM lv")
def level_sort_upper(spark, sf):
    return _schedule(spark, sf, "upper")[1][0]


@query("level_order", _levels_sql("<") + """
SELECT id, level, CAST(row_number() OVER (ORDER BY level, id) - 1 AS BIGINT) AS pos,
       CAST(row_number() OVER (PARTITION BY level ORDER BY id) - 1 AS BIGINT) AS rank FROM lv""")
def level_order(spark, sf):
    ws, (levels, _) = _schedule(spark, sf, "lower")
    return graph.level_order(ws, levels)


_TASKS = _levels_sql("<") + """,
r AS (SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY id) - 1 AS rk,
             count(*) OVER (PARTITION BY level) AS size FROM lv),
t AS (SELECT id, level,
        CASE WHEN rk < (size % 4) * (size // 4 + 1) THEN rk // (size // 4 + 1)
             ELSE size % 4 + (rk - (size % 4) * (size // 4 + 1)) // greatest(size // 4, 1) END AS lane FROM r),
tasks AS (SELECT DISTINCT lane, level FROM t),
te AS (
  SELECT DISTINCT p.lane AS p_lane, p.level AS p_level, c.lane, c.level
  FROM deps JOIN t c ON c.id = deps.id JOIN t p ON p.id = deps.dep
  UNION
  SELECT * FROM (SELECT lag(lane) OVER w AS p_lane, lag(level) OVER w AS p_level, lane, level
                 FROM tasks WINDOW w AS (PARTITION BY lane ORDER BY level)) WHERE p_lane IS NOT NULL)
"""


def _flat(edges):
    return edges.select(
        F.col("parent.lane").alias("p_lane"), F.col("parent.level").alias("p_level"),
        F.col("task.lane").alias("lane"), F.col("task.level").alias("level"),
    )


def _tasks(spark, sf):
    ws, (levels, _) = _schedule(spark, sf, "lower")
    needs = graph.triangle_needs(src.stiffness(spark, sf).df, "lower")
    return ws.save(graph.task_edges(ws, needs, levels, 4)).df


@query("task_graph", _TASKS + "SELECT p_lane, p_level, lane, level FROM te")
def task_graph(spark, sf):
    return _flat(_tasks(spark, sf))


@query("transitive_reduction", _TASKS + """
SELECT p_lane, p_level, lane, level FROM te e WHERE NOT EXISTS (
  SELECT 1 FROM te x JOIN te y ON x.lane = y.p_lane AND x.level = y.p_level
  WHERE x.p_lane = e.p_lane AND x.p_level = e.p_level AND y.lane = e.lane AND y.level = e.level)""")
def transitive_reduction(spark, sf):
    return _flat(graph.drop_shortcuts(_tasks(spark, sf)))


@query("elim_tree", "WITH RECURSIVE " + ARCS.strip() + """,
reach AS (SELECT c_custkey AS root, c_custkey AS x FROM customer
          UNION SELECT root, dst FROM reach JOIN arcs ON src = x WHERE dst < root),
up AS (SELECT root, min(dst) AS parent FROM reach JOIN arcs ON src = x WHERE dst > root GROUP BY 1)
SELECT c_custkey AS id, coalesce(parent, -1) AS parent FROM customer LEFT JOIN up ON root = c_custkey""")
def elim_tree(spark, sf):
    k = src.stiffness(spark, sf)
    return graph.elimination_tree(Workspace(spark), k.df, spark.range(k.nrows))


@query("pseudo_diameter", _CLOSURE + """
SELECT comp, true AS linked, count(*) AS size FROM comps GROUP BY 1""")
def pseudo_diameter(spark, sf):
    """Both ends lie in their component and the level count fits its size."""
    ws, g = Workspace(spark), src.trade_graph(spark, sf)
    comp = graph.components(ws, g)
    ends = ordering.pseudo_diameter(ws, graph.pin_edges(ws, g.edges), comp, ordering.vertex_degrees(g))
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    one = comp.select(F.col("id").alias("source"), F.col("comp").alias("cs"))
    two = comp.select(F.col("id").alias("target"), F.col("comp").alias("ct"))
    fits = (F.col("cs") == F.col("comp")) & (F.col("ct") == F.col("comp")) & F.col("diameter").between(1, F.col("size"))
    return ends.join(sizes, "comp").join(one, "source").join(two, "target").select("comp", fits.alias("linked"), "size")


@query("rcm_valid", "SELECT count(*) AS n, true AS valid FROM customer")
def rcm_valid(spark, sf):
    return structure.permutation_check(ordering.reverse_cuthill_mckee(Workspace(spark), src.trade_graph(spark, sf)))


@query("rcm", _CLOSURE + """,
s AS (SELECT comp, count(*) AS size FROM comps GROUP BY 1),
e AS (SELECT comp, size, sum(size) OVER (ORDER BY comp) AS upto FROM s)
SELECT comp, CAST((SELECT count(*) FROM customer) - upto AS BIGINT) AS first, size FROM e""")
def rcm(spark, sf):
    """Every component occupies one contiguous run, in descending root order."""
    ws, g = Workspace(spark), src.trade_graph(spark, sf)
    order = ordering.reverse_cuthill_mckee(ws, g).df
    comp = graph.components(ws, g)
    runs = order.join(comp, order.old_id == comp.id).groupBy("comp").agg(
        F.min("new_id").alias("first"), (F.max("new_id") - F.min("new_id") + 1).alias("size")
    )
    return runs.select("comp", "first", "size")


@query("rcm_permuted_bandwidth")
def rcm_permuted_bandwidth(spark, sf):
    """Bandwidth before and after reordering."""
    ws, k = Workspace(spark), src.stiffness(spark, sf)
    p = ordering.reverse_cuthill_mckee(ws, src.trade_graph(spark, sf))
    before = stats.bandwidth(k).select(F.lit("given").alias("order"), "bandwidth")
    after = stats.bandwidth(structure.permute(k, p, p)).select(F.lit("rcm").alias("order"), "bandwidth")
    return before.union(after)


@query("nested_dissection", with_(ARCS) + "SELECT src, dst, true AS separated FROM arcs")
def nested_dissection(spark, sf):
    """Every arc stays inside one branch of the dissection, and the end nearer to
    its root is eliminated later: each separator really separates."""
    ws, g = Workspace(spark), src.trade_graph(spark, sf)
    cut = dissection.dissect(ws, g)
    order = cut.permutation(ws, ordering.vertex_degrees(g))
    return dissection.separated(cut, order, g.edges)


@query("nested_dissection_valid", "SELECT count(*) AS n, true AS valid FROM customer")
def nested_dissection_valid(spark, sf):
    return structure.permutation_check(dissection.nested_dissection(Workspace(spark), src.trade_graph(spark, sf)))

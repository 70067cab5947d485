import numpy as np
import pytest
from pyspark.sql import functions as F

from matloom import Graph
from matloom.operators import graph, ordering, structure
from matloom.runtime import Pinned

NINE = {0: [1, 2, 3], 1: [0, 2], 2: [0, 1, 3], 3: [0, 2, 4, 5], 4: [3, 5, 6, 7], 5: [3, 4, 6, 7],
        6: [4, 5, 7, 8], 7: [4, 5, 6], 8: [6]}


def as_graph(spark, adj, n):
    arcs = [(u, v) for u, vs in adj.items() for v in vs]
    return Graph(spark.createDataFrame(arcs, "src long, dst long"), spark.range(n))


def random_adjacency(rng, n, m):
    adj = {u: set() for u in range(n)}
    for u, v in rng.integers(0, n, (m, 2)):
        if u != v:
            adj[int(u)].add(int(v))
            adj[int(v)].add(int(u))
    return adj


def brute_components(adj, n):
    label = list(range(n))
    for u in range(n):
        seen, todo = {u}, [u]
        while todo:
            for v in adj[todo.pop()]:
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        label[u] = max(seen)
    return label


def test_bfs_golden(spark, ws):
    g = as_graph(spark, NINE, 9)
    run = graph.bfs(ws, g, 0)
    assert {r["id"]: r["level"] for r in run.reached.collect()} == dict(enumerate([0, 1, 1, 1, 2, 2, 3, 3, 4]))
    assert (run.height, run.width, run.complete) == (5, 3, True)
    assert [r["id"] for r in run.last_level().collect()] == [8]
    capped = graph.bfs(ws, g, 0, cap=3)
    assert (capped.sizes, capped.complete) == ([1, 3], False)


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_components_match_brute_force(spark, ws, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rng = np.random.default_rng(int(partitions))
    n = 60
    adj = random_adjacency(rng, n, 40)
    chain = {u: adj[u] for u in range(n)}
    for u in range(30, 55):  # a long path, in shuffled order
        a, b = u, u + 1
        chain[a].add(b)
        chain[b].add(a)
    got = {r["id"]: r["comp"] for r in graph.components(ws, as_graph(spark, chain, n)).collect()}
    assert [got[u] for u in range(n)] == brute_components(chain, n)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_level_schedule_and_cycle(spark, ws):
    needs = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 2), (4, 3)], "id long, on long")
    levels, depth = graph.level_schedule(ws, needs, spark.range(6))
    assert {r["id"]: r["level"] for r in levels.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0}
    assert depth == 5
    with pytest.raises(ValueError):
        graph.level_schedule(ws, spark.createDataFrame([(0, 1), (1, 0)], "id long, on long"), spark.range(2))


def fill_by_elimination(adj, n):
    rows = {u: {v for v in adj[u] if v > u} for u in range(n)}
    for u in range(n):
        if rows[u]:
            rows[min(rows[u])] |= rows[u] - {min(rows[u])}
    return rows


def test_elimination_tree_and_complete_fill(spark, ws):
    from matloom.operators.fill import complete_pattern

    n, adj = 25, random_adjacency(np.random.default_rng(4), 25, 40)
    upper = spark.createDataFrame([(u, v) for u in adj for v in adj[u]] + [(u, u) for u in range(n)], "i long, j long")
    rows = fill_by_elimination(adj, n)
    tree = {r["id"]: r["parent"] for r in graph.elimination_tree(ws, upper, spark.range(n)).collect()}
    assert tree == {u: min(rows[u], default=-1) for u in range(n)}
    cells = {(r["i"], r["j"]) for r in complete_pattern(ws, upper, spark.range(n)).collect()}
    assert cells == {(u, v) for u in rows for v in rows[u]} | {(u, u) for u in range(n)}


def test_reordering_a_shuffled_grid_reduces_the_bandwidth(spark, ws):
    side = 6
    names = np.random.default_rng(0).permutation(side * side)
    adj = {int(x): [] for x in names}
    for r in range(side):
        for c in range(side):
            for dr, dc in ((0, 1), (1, 0)):
                if r + dr < side and c + dc < side:
                    u, v = int(names[r * side + c]), int(names[(r + dr) * side + c + dc])
                    adj[u].append(v)
                    adj[v].append(u)
    g = as_graph(spark, adj, side * side)
    p = ordering.reverse_cuthill_mckee(ws, g)
    assert structure.permutation_check(p).first()["valid"]
    place = {r["old_id"]: r["new_id"] for r in p.df.collect()}
    width = max(abs(place[u] - place[v]) for u in adj for v in adj[u])
    before = max(abs(u - v) for u in adj for v in adj[u])
    assert width <= 2 * side < before
    ends = ordering.graph_pseudo_diameter(ws, g).collect()
    assert len(ends) == 1 and ends[0]["diameter"] == 2 * side - 1


def test_shortcut_edges_are_dropped(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (1, 4)], "parent long, task long")
    kept = {(r[0], r[1]) for r in graph.drop_shortcuts(edges).collect()}
    assert kept == {(1, 2), (2, 3), (3, 4)}


def test_pinned_hub_is_split_and_joins_whole(spark, ws):
    """A third of all rows share one key; the bucketed layout cuts it up."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("j"),
        F.col("id").alias("i"), F.lit(1.0).alias("v"),
    )
    other = spark.range(9000).select(F.col("id").alias("j"), (F.col("id") * 2.0).alias("x"))
    pinned = Pinned(ws, rows, "j", bucket_rows=500)
    assert pinned.table and pinned.hubs.count() == 1
    pieces = spark.table(pinned.table).where("j = 7").groupBy("salt").count().collect()
    assert len(pieces) > 3 and max(r["count"] for r in pieces) < 1000
    total = pinned.join(other).agg(F.count("*"), F.sum("x")).first()
    plain = rows.join(other, "j").agg(F.count("*"), F.sum("x")).first()
    assert tuple(total) == tuple(plain)
    small = ws.save(other, rows=F.count("*"))
    assert tuple(pinned.join(small.df, small).agg(F.count("*"), F.sum("x")).first()) == tuple(plain)
    pinned.release()

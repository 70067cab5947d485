"""Nested dissection: an order with little fill from recursive vertex separators.

All parts of one depth are cut together, so the number of jobs grows with the
depth of the recursion and never with the number of parts.  A part is a connected
component of what earlier separators have left.  Breadth-first levels from a
vertex of least degree offer one separator per level: the vertices with a
neighbour in the next one.  The level with the smallest separator per vertex of
its smaller side is taken, then the boundary is refined: separator vertices move
to one side at a time wherever they pull fewer vertices of the other side in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.functions.scan import dense_position
from matloom.model import Graph, Permutation
from matloom.operators.graph import components, traverse
from matloom.runtime import Pinned, RoundLog, Saved, Workspace

#: Parts of at most so many vertices are not cut; beyond the depth nothing is.
LEAF, MAX_DEPTH = 32, 48
#: Refinement passes, alternately towards either side.
PASSES = 2
#: A pass may take at most this share of the side it pulls vertices from.
YIELD = 0.25

NEAR, CUT, FAR = 0, 1, 2


@dataclass(frozen=True)
class Dissection:
    """``tree``: ``(id, depth, path)``.  The path names the parts a vertex lay in,
    from the whole component down to the one it separates or ends in; arcs join
    only vertices of which one path begins with the other."""

    tree: DataFrame
    n: int

    def permutation(self, ws: Workspace, degrees: DataFrame) -> Permutation:
        """Deeper vertices first, part by part; inside a part by degree and id.

        A separator stands behind everything it separates, which is all that
        fill depends on.
        """
        rows = self.tree.join(degrees, "id").select("id", (-F.col("depth")).alias("up"), F.element_at("path", -1).alias("part"), "deg")
        order = [F.col("up"), F.col("part"), F.col("deg"), F.col("id")]
        placed = dense_position(ws, rows, order, "pos")
        return Permutation(placed.select(F.col("pos").alias("new_id"), F.col("id").alias("old_id")), self.n)


def dissect(ws: Workspace, g: Graph, leaf: int = LEAF, max_depth: int = MAX_DEPTH) -> Dissection:
    """Cut all components of ``g`` until their parts have ``leaf`` vertices or no
    separator.  Directions of arcs do not matter."""
    edges = ws.save(g.undirected())
    active = ws.save(g.vertices.select("id", F.array().cast("array<bigint>").alias("path")), rows=F.count(F.lit(1)))
    n, depth = active.rows, 0
    log = RoundLog(ws, "id long, path array<bigint>")
    while active.rows:
        comp = components(ws, Graph(edges.df, active.df.select("id")))
        named = active.df.join(comp, "id").select("id", F.col("comp").alias("part"), F.concat("path", F.array("comp")).alias("path"))
        named = ws.save(named)
        size = named.df.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
        large = ws.save(named.df.join(size.where(F.col("size") > (leaf if depth < max_depth else n)), "part").select("id", "part", "size"), rows=F.count(F.lit(1)))
        if not large.rows:
            log.append(named.df.select("id", "path"))
            break
        sides = bisect(ws, edges.df, large.df)
        # Uncut parts end here, and so do separators; both sides go on.
        marked = ws.save(named.df.join(sides, "id", "left").select("id", "path", (F.col("side") != CUT).alias("on")))
        log.append(marked.df.where("NOT coalesce(on, false)").select("id", "path"))
        rest = ws.save(marked.df.where("on").select("id", "path"), rows=F.count(F.lit(1)))
        left = rest.df.select("id")
        inner = edges.df.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi")
        inner = ws.save(inner.select("src", "dst"))
        ws.discard(edges, active, named, large, marked)
        edges, active, depth = inner, rest, depth + 1
    return Dissection(log.all().select("id", F.col("round").cast("int").alias("depth"), "path"), n)


def bisect(ws: Workspace, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """``(id, part, side)`` of every vertex in a part that can be cut.

    ``edges`` hold both directions and stay inside parts; ``parts`` are connected
    ``(id, part, size)``.
    """
    arcs = Pinned(ws, edges.join(parts.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"), "src")
    degrees = ws.save(arcs.df.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))).df

    best = parts.join(degrees, "id").groupBy("part").agg(F.min(F.struct("deg", "id")).alias("m"))
    seeds = ws.save(best.select(F.col("part").alias("slot"), F.col("m.id").alias("id"))).df
    found = traverse(ws, arcs, seeds, symmetric=True).reached
    levels = ws.save(found.select("id", F.col("slot").alias("part"), "level"))
    # Vertices with a neighbour one level on are the separator of their level.
    there = levels.df.select(F.col("id").alias("dst"), F.col("level").alias("next"))
    here = levels.df.select(F.col("id").alias("src"), "level")
    front = arcs.join(here).join(there, "dst").where("next = level + 1").select(F.col("src").alias("id")).distinct()
    placed = ws.save(levels.df.join(front.withColumn("front", F.lit(True)), "id", "left").select("id", "part", "level", F.coalesce("front", F.lit(False)).alias("front")))
    cut = _best_level(placed.df)
    side = F.when(F.col("level") > F.col("cut"), FAR).when((F.col("level") == F.col("cut")) & F.col("front"), CUT).otherwise(NEAR)
    state = ws.save(placed.df.join(cut, "part").select("id", "part", side.alias("side")))
    for k in range(PASSES):
        state, moved = _refine(ws, arcs, state, *((NEAR, FAR) if k % 2 == 0 else (FAR, NEAR)))
        if not moved and k:
            break
    arcs.release()
    return state.df


def _best_level(placed: DataFrame) -> DataFrame:
    """``(part, cut)``: the level of the smallest separator for its smaller side.

    The counted levels of a part, one for each job of its search, are folded in
    order.
    """
    per = placed.groupBy("part", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if("front").alias("s"))
    rows = per.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("level", "n", "s"))).alias("levels"), F.sum("n").alias("size"))
    none = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("int").alias("cut"))

    def step(a, x):
        upto = a["upto"] + x["n"]
        smaller = F.least(upto - x["s"], F.col("size") - upto)
        cost = F.when(smaller > 0, x["s"] / smaller)
        better = cost.isNotNull() & (a["cost"].isNull() | (cost < a["cost"]))
        return F.struct(upto.alias("upto"), F.when(better, cost).otherwise(a["cost"]).alias("cost"), F.when(better, x["level"]).otherwise(a["cut"]).alias("cut"))

    best = F.aggregate("levels", none, step)["cut"]
    return rows.select("part", best.alias("cut")).where("cut IS NOT NULL")


def _refine(ws: Workspace, arcs: Pinned, state: Saved, to: int, other: int) -> tuple[Saved, int]:
    """Move separator vertices to side ``to`` where that makes the separator smaller.

    A vertex without a neighbour on the ``other`` side moves freely; several whose
    only neighbour there is the same vertex change places with it.
    """
    cut = state.df.where(F.col("side") == CUT).select(F.col("id").alias("src"), "part")
    across = state.df.where(F.col("side") == other).select(F.col("id").alias("dst"))
    pulls = arcs.join(cut).join(across, "dst").groupBy("src", "part").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("pull"))
    pulls = ws.save(pulls)
    free = cut.join(pulls.df, "src", "left_anti").select(F.col("src").alias("id"), "part", F.lit(None).cast("bigint").alias("pull"))
    shared = pulls.df.where("n = 1").groupBy("pull", "part").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    room = state.df.groupBy("part").agg(F.count_if(F.col("side") == other).alias("room"))
    wanted = shared.groupBy("part").agg(F.count(F.lit(1)).alias("wanted")).join(room, "part").where(F.col("wanted") <= YIELD * F.col("room"))
    shared = ws.save(shared.join(wanted.select("part"), "part", "left_semi").select("pull"))
    swap = pulls.df.where("n = 1").join(shared.df, "pull", "left_semi").select(F.col("src").alias("id"))
    moves = free.select("id").union(swap).withColumn("new", F.lit(to)).union(shared.df.select(F.col("pull").alias("id"), F.lit(CUT)))
    moves = ws.save(moves, rows=F.count(F.lit(1)))
    if not moves.rows:
        return state, 0
    nxt = ws.save(state.df.join(moves.df, "id", "left").select("id", "part", F.coalesce("new", "side").alias("side")))
    return nxt, moves.rows


def nested_dissection(ws: Workspace, g: Graph, leaf: int = LEAF) -> Permutation:
    """A fill-reducing order of all vertices."""
    counts = g.undirected().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    degrees = g.vertices.join(counts, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))
    return dissect(ws, g, leaf).permutation(ws, degrees)


def separated(d: Dissection, order: Permutation, edges: DataFrame) -> DataFrame:
    """``(src, dst, separated)``: whether one end's path begins with the other's,
    and the end with the shorter path stands later in the order."""
    rows = d.tree.join(order.df.withColumnRenamed("old_id", "id"), "id").select("id", "path", "new_id")
    a = rows.toDF("src", "path_a", "pos_a")
    b = rows.toDF("dst", "path_b", "pos_b")
    na, nb = F.size("path_a"), F.size("path_b")
    nested = F.slice("path_a", 1, F.least(na, nb)) == F.slice("path_b", 1, F.least(na, nb))
    behind = (na == nb) | ((na < nb) == (F.col("pos_a") > F.col("pos_b")))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (nested & behind).alias("separated"))

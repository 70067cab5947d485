"""Traversal, components, level schedules and elimination trees.

Each loop runs one frontier or one label round as a Spark job over the whole
edge table; rounds are appended to shared storage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matloom.functions.scan import dense_position, rank_within
from matloom.model import Graph
from matloom.runtime import Pinned, RoundLog, Saved, Workspace

def pin_edges(ws: Workspace, edges: DataFrame) -> Pinned:
    """Arcs laid out for frontier expansion, keyed by their source."""
    return Pinned(ws, edges.select("src", "dst").where("src <> dst").distinct(), "src")


# -- breadth-first search ---------------------------------------------------


@dataclass(frozen=True)
class Traversal:
    """Reached vertices ``(slot, id, level)``; ``sizes`` lists the level sizes."""

    reached: DataFrame
    sizes: list[int]
    complete: bool

    @property
    def height(self) -> int:
        return len(self.sizes)

    @property
    def width(self) -> int:
        return max(self.sizes)

    def last_level(self) -> DataFrame:
        return self.reached.where(F.col("level") == self.height - 1).select("id")


def traverse(ws: Workspace, arcs: Pinned, seeds: DataFrame, cap: int | None = None, symmetric: bool = False) -> Traversal:
    """Breadth-first levels from ``seeds`` ``(slot, id)``; slots are independent
    searches that advance together.  A level of ``cap`` vertices stops the run.

    Where every arc has its reverse (``symmetric``), a neighbour lies at most one
    level away, so new vertices are told from the last two levels alone; that
    holds for several seeds of one slot as well.
    """
    log = RoundLog(ws, "slot long, id long")
    sizes = [log.append(seeds.select("slot", "id")).rows]
    complete = cap is None or sizes[0] < cap
    while complete:
        frontier = log.last.df.withColumnRenamed("id", "src")
        touched = arcs.join(frontier, log.last).select("slot", F.col("dst").alias("id")).distinct()
        known = log.recent(2) if symmetric else log.all()
        # A hash table of two keys takes a whole page of memory, however few its rows.
        fresh = log.append(touched.join(known.hint("merge"), ["slot", "id"], "left_anti")).rows
        if not fresh:
            break
        sizes.append(fresh)
        complete = cap is None or fresh < cap
    reached = log.all().select("slot", "id", F.col("round").alias("level"))
    return Traversal(reached, sizes, complete)


def bfs(ws: Workspace, g: Graph, source: int, cap: int | None = None) -> Traversal:
    seeds = ws.spark.range(source, source + 1).select(F.lit(0).cast("bigint").alias("slot"), "id")
    arcs = pin_edges(ws, g.edges)
    return traverse(ws, arcs, seeds, cap, symmetric=is_symmetric(arcs.df))


def is_symmetric(arcs: DataFrame) -> bool:
    """Whether each arc of distinct ``(src, dst)`` has its reverse."""
    ends = arcs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n <> 2").isEmpty()


def bfs_levels(ws: Workspace, g: Graph, source: int, cap: int | None = None) -> DataFrame:
    """``(id, level)`` of every vertex, −1 where the search did not come."""
    found = bfs(ws, g, source, cap).reached.select("id", "level")
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("level", F.lit(-1)).alias("level"))


# -- components -------------------------------------------------------------


def components(ws: Workspace, g: Graph) -> DataFrame:
    """``(id, comp)``; comp is the largest id of the component.

    Label rounds with parent hooking and shortcutting (the FastSV scheme): the
    number of rounds grows with the logarithm of the longest path.
    """
    both = g.undirected()
    arcs = Pinned(ws, both, "dst")
    best = both.groupBy(F.col("src").alias("id")).agg(F.max("dst").alias("top"))
    start = g.vertices.select("id").join(best, "id", "left")
    state = ws.save(start.select("id", F.greatest("id", F.coalesce("top", "id")).alias("f")))
    while True:
        parents = state.df.select(F.col("id").alias("f"), F.col("f").alias("gf"))
        here = ws.save(state.df.select("id", "f").join(parents, "f").select("id", "f", "gf"))
        labels = here.df.select(F.col("id").alias("dst"), "gf")
        seen = arcs.join(labels, here).groupBy(F.col("src").alias("id")).agg(F.max("gf").alias("near"))
        known = here.df.join(seen, "id", "left")
        # A neighbour's label also lifts the parent of the vertex that saw it.
        hooks = known.groupBy(F.col("f").alias("id")).agg(F.max("near").alias("hook"))
        lifted = known.join(hooks, "id", "left").select(
            "id", "f", F.greatest("f", "gf", "near", "hook").alias("new")
        )
        nxt = ws.save(
            lifted.select("id", F.col("new").alias("f"), (F.col("new") != F.col("f")).alias("moved")),
            rows=F.count(F.lit(1)),
            moved=F.count_if("moved"),
        )
        ws.discard(here, state)
        state = nxt
        if not nxt.stats["moved"]:
            arcs.release()
            return state.df.select("id", F.col("f").alias("comp"))


def component_count(comp: DataFrame) -> DataFrame:
    return comp.agg(F.count_if(F.col("id") == F.col("comp")).alias("components"))


def component_members(ws: Workspace, comp: DataFrame) -> DataFrame:
    """``(comp, id, pos, rank)``: members grouped by ascending root; ``pos`` is
    the place in the whole list, ``rank`` the place in the component."""
    placed = dense_position(ws, comp, [F.col("comp"), F.col("id")], "pos")
    starts = placed.groupBy("comp").agg(F.min("pos").alias("start"))
    return placed.join(starts, "comp").select("comp", "id", "pos", (F.col("pos") - F.col("start")).alias("rank"))


def component_stats(ws: Workspace, comp: DataFrame) -> DataFrame:
    """``(comp, size, start)``: roots with member counts and exclusive offsets."""
    placed = dense_position(ws, comp, [F.col("comp"), F.col("id")], "pos")
    return placed.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.min("pos").alias("start"))


def same_component(comp: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, same)`` for pairs ``(a, b)``."""
    left = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    right = comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("ca") == F.col("cb")).alias("same"))


# -- level schedules --------------------------------------------------------


def level_schedule(ws: Workspace, needs: DataFrame, vertices: DataFrame) -> tuple[DataFrame, int]:
    """Longest-path levels ``(id, level)`` and their number.

    ``needs`` holds ``(id, on)``: id comes after on.  A round writes the rows it
    meets and the rows still open side by side; only the open ones go on.
    """
    arcs = Pinned(ws, needs.where("id <> on").select(F.col("on").alias("src"), F.col("id").alias("dst")).distinct(), "src")
    waits = arcs.df.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("left"))
    counted = vertices.select("id").join(waits, "id", "left").select("id", F.coalesce("left", F.lit(0)).alias("left"))
    base, rounds, before = ws.new_path("levels"), 0, None
    while True:
        here = ws.save(
            counted.withColumn("done", F.col("left") == 0),
            partition_by="done",
            path=f"{base}/round={rounds}",
            even=False,
            waiting=F.count_if(F.col("left") > 0),
        )
        if rounds:
            ws.discard(Saved(before.df, f"{base}/round={rounds - 1}/done=false"))
        rounds += 1
        if not here.stats["waiting"]:
            break
        if here.stats["waiting"] == here.rows:
            raise ValueError("the dependencies contain a cycle")
        met = here.df.where("done").select(F.col("id").alias("src"))
        met = arcs.join(met, here).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("met"))
        still = here.df.where("NOT done").join(met, "id", "left")
        counted = still.select("id", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"))
        before = here
    arcs.release()
    met = ws.spark.read.schema("id long, left long, round int, done boolean").parquet(base).where("done")
    return met.select("id", F.col("round").alias("level")), rounds


def triangle_needs(entries: DataFrame, side: str) -> DataFrame:
    """Row dependencies of the strict lower or upper triangle."""
    keep = "j < i" if side == "lower" else "j > i"
    return entries.where(keep).select(F.col("i").alias("id"), F.col("j").alias("on"))


def level_order(ws: Workspace, levels: DataFrame) -> DataFrame:
    """``(id, level, pos, rank)``: ids by level, then ascending."""
    ranked = dense_position(ws, levels, [F.col("level"), F.col("id")], "pos")
    starts = ranked.groupBy("level").agg(F.min("pos").alias("start"))
    return ranked.join(starts, "level").select("id", "level", "pos", (F.col("pos") - F.col("start")).alias("rank"))


# -- task graph -------------------------------------------------------------


def task_edges(ws: Workspace, needs: DataFrame, levels: DataFrame, lanes: int) -> DataFrame:
    """``(parent, task)`` between (lane, level) groups, with the chain inside
    each lane; rows of a level are dealt to lanes in even contiguous runs."""
    order = rank_within(ws, levels, ["level"], [F.col("id")], "rank")
    sizes = order.groupBy("level").agg(F.count(F.lit(1)).alias("size"))
    short, extra = F.expr(f"size div {lanes}"), F.col("size") % lanes
    long_rows = extra * (short + 1)
    lane = F.when(F.col("rank") < long_rows, F.expr(f"rank div (size div {lanes} + 1)")).otherwise(
        extra + ((F.col("rank") - long_rows) / F.greatest(short, F.lit(1))).cast("bigint")
    )
    placed = order.join(sizes, "level").select("id", F.struct(lane.alias("lane"), "level").alias("task"))
    table = ws.save(placed).df
    child = table.select("id", "task")
    parent = table.select(F.col("id").alias("on"), F.col("task").alias("parent"))
    across = needs.where("id <> on").join(child, "id").join(parent, "on").select("parent", "task").where("parent <> task")
    chain = _lane_chain(table)
    return across.union(chain).distinct()


def _lane_chain(table: DataFrame) -> DataFrame:
    """Consecutive tasks of one lane; levels of a lane are contiguous from 0
    except where a short level leaves the lane empty."""
    tasks = table.select("task").distinct()
    w = Window.partitionBy("task.lane").orderBy("task.level")
    return tasks.select(F.lag("task").over(w).alias("parent"), "task").where("parent IS NOT NULL")


def drop_shortcuts(edges: DataFrame) -> DataFrame:
    """Remove a→c wherever some b has a→b and b→c (paths of length two)."""
    first = edges.select(F.col("parent").alias("a"), F.col("task").alias("b"))
    second = edges.select(F.col("parent").alias("b"), F.col("task").alias("c"))
    closed = first.join(second, "b").select(F.col("a").alias("parent"), F.col("c").alias("task"))
    return edges.join(closed, ["parent", "task"], "left_anti")


# -- elimination ------------------------------------------------------------


def elimination_tree(ws: Workspace, upper: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(id, parent)`` of the symmetric pattern whose strict upper cells are
    ``(i, j)``; roots have parent −1.

    Every vertex keeps its lowest upper neighbour and hands the others to it.
    That leaves the tree unchanged and never adds cells, so the table only
    shrinks until each vertex holds one neighbour.
    """
    cells = ws.save(upper.where("i < j").select("i", "j").distinct())
    while True:
        low = cells.df.groupBy("i").agg(F.min("j").alias("p"))
        lifted = cells.df.join(low, "i").select(
            F.when(F.col("j") == F.col("p"), F.col("i")).otherwise(F.col("p")).alias("i"),
            "j",
            (F.col("j") != F.col("p")).alias("moved"),
        )
        merged = lifted.groupBy("i", "j").agg(F.max("moved").alias("moved"))
        nxt = ws.save(merged, moved=F.count_if("moved"))
        ws.discard(cells)
        cells = nxt
        if not nxt.stats["moved"]:
            break
    return vertices.join(cells.df.select(F.col("i").alias("id"), F.col("j").alias("parent")), "id", "left").select(
        "id", F.coalesce("parent", F.lit(-1)).cast("bigint").alias("parent")
    )


def quotient_graph(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Initial quotient graph: variables ``(id, degree, weight)`` and their
    neighbours ``(id, nbr)``, kept as rows so a hub is never one value."""
    nbrs = g.edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("nbr")).distinct()
    counts = nbrs.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    variables = g.vertices.join(counts, "id", "left").select(
        "id", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(1).cast("bigint").alias("weight")
    )
    return variables, nbrs

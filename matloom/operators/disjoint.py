"""Disjoint sets that grow by batches of links and stay on shared storage.

A batch stores two small tables: the members it met first, with their root, and
the roots it merged into others.  Links are carried over to current roots before
anything is grouped, so a batch works on the sets it touches only.  A root is
merged at most once, and always into the largest member, so the root of an element
follows from its own row and a chain of merges; chains are folded when enough
batches have come together.

A batch counts when its marker exists, which is created last and by one writer
only: a repeated batch id changes nothing, and half a batch is never seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.model import Graph
from matloom.operators.graph import components
from matloom.runtime import Workspace

#: Batches after which the merges are folded into one table.
FOLD = 16


class DisjointSets:
    """Sets of long ids below ``path``; several sessions may use them in turn."""

    def __init__(self, ws: Workspace, path: str, fold: int = FOLD):
        self.ws, self.path, self.fold = ws, path.rstrip("/"), fold

    def batches(self) -> list[str]:
        """Names of all committed batches, oldest first."""
        folder, fs = self.ws._located(f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        return sorted(x.getPath().getName().split("=", 1)[1] for x in fs.listStatus(folder))

    def unite(self, links: DataFrame, batch: str) -> bool:
        """Merge the sets of the ends of all links ``(a, b)``; an end not met before
        is a set of its own.  False if the batch is there already."""
        done = self.batches()
        if any(name.split("~", 1)[1] == batch for name in done):
            return False
        ws, name = self.ws, f"{len(done):08d}~{batch}"
        links = ws.save(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()).df
        ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
        roots = ws.save(self._roots(ends)).df
        a, b = roots.select(F.col("id").alias("a"), F.col("root").alias("src")), roots.select(F.col("id").alias("b"), F.col("root").alias("dst"))
        between = ws.save(links.join(a, "a").join(b, "b").where("src <> dst").select("src", "dst").distinct()).df
        groups = components(ws, Graph(between, roots.select(F.col("root").alias("id")).distinct()))
        groups = ws.save(groups.select(F.col("id").alias("root"), F.col("comp").alias("into"))).df
        fresh = roots.where("fresh").join(groups, "root").select("id", F.col("into").alias("root"))
        # Only roots that stood before are merged; new members know their root.
        merged = groups.where("root <> into").join(roots.where("NOT fresh").select("root").distinct(), "root", "left_semi")
        self._write(fresh, f"members/{name}")
        self._write(merged, f"merges/{name}")
        return self._commit(name)

    def find(self, ids: DataFrame) -> DataFrame:
        """``(id, root)``; the root is the largest member of the set of ``id``."""
        return self._roots(ids.select("id").distinct()).select("id", "root")

    def all(self) -> DataFrame:
        """``(id, root)`` of every element met so far."""
        names = self.batches()
        return self._chase(self._read("members", names, "id long, root long"), names)

    def _roots(self, ids: DataFrame) -> DataFrame:
        """``(id, root, fresh)``; an element not met before is its own root."""
        names = self.batches()
        members = self._read("members", names, "id long, root long")
        met = self._chase(ids.join(members, "id"), names)
        rows = ids.join(met, "id", "left")
        return rows.select("id", F.coalesce("root", "id").alias("root"), F.col("root").isNull().alias("fresh"))

    def _chase(self, rows: DataFrame, names: list[str]) -> DataFrame:
        ws, merges = self.ws, self._merges(names)
        now = ws.save(rows.select("id", "root", F.lit(True).alias("moved")), moved=F.count_if("moved"))
        while now.stats["moved"]:
            step = now.df.drop("moved").join(merges, "root", "left")
            nxt = step.select("id", F.coalesce("into", "root").alias("root"), F.col("into").isNotNull().alias("moved"))
            before, now = now, ws.save(nxt, moved=F.count_if("moved"))
            ws.discard(before)
        return now.df.select("id", "root")

    def _merges(self, names: list[str]) -> DataFrame:
        """``(root, into)``: folded ones of older batches, and those of newer ones."""
        whole = len(names) // self.fold * self.fold
        new = self._read("merges", names[whole:], "root long, into long")
        if not whole:
            return new
        folder, fs = self.ws._located(f"{self.path}/folded/{whole:08d}")
        if not fs.exists(self.ws._located(f"{self.path}/folded/{whole:08d}/_SUCCESS")[0]):
            every = self._read("merges", names[:whole], "root long, into long")
            now = self.ws.save(every, rows=F.count(F.lit(1)))
            while True:
                # Each round joins chains to their own continuation and halves them.
                on = now.df.select(F.col("root").alias("into"), F.col("into").alias("next"))
                step = now.df.join(on, "into", "left")
                nxt = step.select("root", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("moved"))
                now = self.ws.save(nxt, moved=F.count_if("moved"))
                if not now.stats["moved"]:
                    break
                now = self.ws.save(now.df.drop("moved"))
            now.df.select("root", "into").write.mode("overwrite").parquet(folder.toString())
        return self.ws.spark.read.schema("root long, into long").parquet(folder.toString()).unionAll(new)

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.ws.spark.createDataFrame([], schema)
        return self.ws.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def _write(self, df: DataFrame, place: str) -> None:
        # Rows that a failed attempt has left under this name are replaced.
        df.write.mode("overwrite").parquet(f"{self.path}/{place}")

    def _commit(self, name: str) -> bool:
        marker, fs = self.ws._located(f"{self.path}/commits/batch={name}")
        try:
            fs.create(marker, False).close()
        except Exception as e:
            if "already exists" in str(e):
                return False
            raise
        return True

"""Graphs as two DataFrames: nodes (id) and edges (from, to, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settled


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    def add_node(self, *ids) -> Graph:
        new = self.nodes.sparkSession.createDataFrame([(i,) for i in ids], self.nodes.schema)
        return Graph(self.nodes.union(new).distinct(), self.edges, self.directed)

    def add_edge(self, a, b, weight: float = 1.0) -> Graph:
        new = self.edges.sparkSession.createDataFrame([(a, b, weight)], self.edges.schema)
        return Graph(self.add_node(a, b).nodes, self.edges.union(new), self.directed)

    def remove_node(self, node) -> Graph:
        return Graph(self.nodes.filter(F.col("id") != node), self.edges.filter((F.col("from") != node) & (F.col("to") != node)), self.directed)

    def remove_edge(self, a, b) -> Graph:
        """One of the edges from a to b, that of the smallest weight."""
        same = (F.col("from") == a) & (F.col("to") == b)
        hit = self.edges.filter(same)
        rest = hit.exceptAll(hit.orderBy("weight").limit(1))
        return Graph(self.nodes, self.edges.filter(~same).union(rest), self.directed)

    def _both(self) -> DataFrame:
        e = self.edges.select(F.col("from").alias("a"), F.col("to").alias("b"))
        return e if self.directed else e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def neighbors(self, node) -> DataFrame:
        return self._both().filter(F.col("a") == node).select(F.col("b").alias("id")).distinct().orderBy("id")

    def degrees(self) -> DataFrame:
        n = self.edges.select(F.explode(F.array("from", "to")).alias("id")).groupBy("id").count()
        return self.nodes.join(n, "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("degree"))

    def degree(self, node) -> DataFrame:
        return self.degrees().filter(F.col("id") == node)

    def has_node(self, node) -> bool:
        return bool(self.nodes.filter(F.col("id") == node).limit(1).count())

    def has_edge(self, a, b) -> bool:
        return bool(self._both().filter((F.col("a") == a) & (F.col("b") == b)).limit(1).count())

    def node_attr(self, node, name: str):
        """An attribute of a node: a column of nodes; None without the node."""
        row = self.nodes.filter(F.col("id") == node).select(name).first()
        return row[0] if row else None

    def subgraph(self, ids: DataFrame) -> Graph:
        e = self.edges.join(ids.select(F.col("id").alias("from")), "from", "left_semi").join(ids.select(F.col("id").alias("to")), "to", "left_semi")
        return Graph(self.nodes.join(ids, "id", "left_semi"), e.select("from", "to", "weight"), self.directed)

    def node_count(self) -> DataFrame:
        return self.nodes.agg(F.count(F.lit(1)).alias("nodes"))

    def edge_count(self) -> DataFrame:
        return self.edges.agg(F.count(F.lit(1)).alias("edges"))

    def connected_components(self, max_rounds: int | None = None) -> DataFrame:
        """(id, component): the smallest reachable id, by rounds of least neighbours with jumps over found roots, until nothing
        changes.  Raises if a bound max_rounds is given and reached before that."""
        both = self._both() if not self.directed else Graph(self.nodes, self.edges)._both()
        both = settled(both.filter("a <> b").distinct())
        comp = self.nodes.select("id", F.col("id").alias("component"))
        done = 0
        while max_rounds is None or done < max_rounds:
            done += 1
            near = both.join(comp, both.b == comp.id).groupBy("a").agg(F.min("component").alias("m"))
            step = comp.join(near, comp.id == near.a, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
            root = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
            new = step.join(root, "component").select("id", F.col("root").alias("component"))
            new = settled(new)
            old = comp.withColumnRenamed("component", "before")
            if not new.join(old, "id").filter("component <> before").limit(1).count():
                return new
            comp = new
        raise RuntimeError("the components did not settle")

    def shortest_path(self, a, b, max_steps: int | None = None) -> list | None:
        """Nodes of an unweighted path, None if there is none: frontiers of arrays of nodes, one kept for each node reached,
        until b is met or nothing new is reached.  Raises if a bound max_steps is given and reached before that."""
        both = settled(self._both().select("a", "b").distinct())
        front = settled(self.nodes.filter(F.col("id") == a).select("id", F.array("id").alias("path")))
        seen, step = front.select("id"), 0
        while True:
            hit = front.filter(F.col("id") == b).select("path").head()
            if hit:
                return hit[0]
            if max_steps is not None and step >= max_steps:
                raise RuntimeError(f"no path of {max_steps} edges or fewer, and the search did not end")
            nxt = both.join(front, both.a == front.id).groupBy("b").agg(F.min("path").alias("path"))
            front = settled(nxt.join(seen, nxt.b == seen.id, "left_anti").select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path")))
            if front.isEmpty():
                return None
            step += 1
            seen = seen.unionByName(front.select("id"))
            if step % 16 == 0:
                seen = settled(seen.coalesce(both.rdd.getNumPartitions()))


def graph(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> Graph:
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    return Graph(nodes.select("id").distinct(), edges.select("from", "to", "weight"), directed)

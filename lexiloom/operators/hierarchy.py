"""Directed graphs of classes: strongly connected components and longest paths, in rounds that double the steps.

Edges (``a``, ``b``) lead from a to b. A table of jumps holds the pairs that exactly 2^k steps join; joined with itself it
holds those of 2^(k+1), so a chain of n is done after log2(n) rounds. Jumps of a tree are as many as its nodes, those of
a graph with many ways up to nodes times width; where they exceed ``SPREAD`` times the edges, as in a large component with
many cycles, they aren't doubled further, and values go on along edges and the last jumps until nothing changes: rounds then
grow with the longest way divided by those jumps' steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.graph import written

SPREAD = 8


def doubled(jumps: DataFrame) -> DataFrame:
    """Pairs joined by twice as many steps."""
    second = jumps.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return jumps.join(second, "b").select("a", F.col("c").alias("b")).distinct()


class Jumps:
    """The table of jumps of an edge table, doubled as long as it stays small."""

    def __init__(self, edges: DataFrame, n_edges: int):
        self.table, self.size, self.steps, self.most, self.grows = edges, n_edges, 1, SPREAD * max(n_edges, 64), True

    def double(self) -> None:
        if self.grows and self.size:
            longer = written(doubled(self.table))
            size = longer.count()
            self.grows = size <= self.most
            if self.grows:
                self.table, self.size, self.steps = longer, size, 2 * self.steps


def cyclic_core(edges: DataFrame) -> DataFrame | None:
    """Edges among nodes that both reach and are reached by as many steps as there are nodes: all that lie on a cycle
    or between two; None if nothing can. Where jumps were not doubled that far, some more."""
    n_edges = edges.count()
    jumps = Jumps(edges, n_edges)
    while jumps.grows and jumps.size and jumps.steps <= n_edges:
        jumps.double()
    if not jumps.size:
        return None
    both = jumps.table.select(F.col("a").alias("node")).intersect(jumps.table.select(F.col("b").alias("node")))
    both = written(both)
    inside = edges.join(both.withColumnRenamed("node", "a"), "a", "left_semi").join(both.withColumnRenamed("node", "b"), "b", "left_semi")
    return written(inside.select("a", "b"))


def lowest_reached(edges: DataFrame) -> DataFrame:
    """``node``, ``low`` and ``from``: the least hash (then name) of the nodes that it reaches and of those that reach it, itself
    included. Both ways go on in the same rounds."""
    end = lambda way, c: F.struct(F.lit(way).alias("way"), F.col(c).alias("node"))
    both = written(edges.select(end(0, "a").alias("a"), end(0, "b").alias("b")).union(edges.select(end(1, "b"), end(1, "a"))))
    low = both.select(F.col("a").alias("at")).union(both.select("b")).distinct().select("at", F.struct(F.xxhash64("at.node").alias("h"), F.col("at.node").alias("name")).alias("low"))
    low = written(low)
    jumps = Jumps(both, both.count())
    while True:
        ways = both.unionByName(jumps.table) if jumps.steps > 1 else both
        sent = ways.join(low, ways["b"] == low["at"]).groupBy("a").agg(F.min("low").alias("sent"))
        new = low.join(sent, low["at"] == sent["a"], "left").select("at", F.least("low", F.coalesce("sent", "low")).alias("low"), (F.col("sent") < F.col("low")).alias("fell"))
        new = written(new)
        low = new.select("at", "low")
        if not new.where("fell").limit(1).count():
            break
        jumps.double()
    one = lambda way, name: low.where(F.col("at.way") == way).select(F.col("at.node").alias("node"), F.col("low").alias(name))
    return written(one(0, "low").join(one(1, "from"), "node"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of the nodes on cycles, from distinct edges (``a``, ``b``) without nulls.

    Nodes of one component reach the same nodes and are reached by the same, so they have the least of either in common.
    A node whose two least nodes are one and the same is in that node's component; edges between nodes that differ in
    either go, and what may still lie on cycles starts anew. The least is taken by hash, so few turns are needed.
    """
    left, found = cyclic_core(edges.where("a <> b")), None
    while left is not None and left.limit(1).count():
        both = lowest_reached(left)
        done = both.where(F.col("low") == F.col("from")).select("node", F.col("low.name").alias("colour"))
        found = done if found is None else found.unionByName(done)
        open_ = both.where(F.col("low") != F.col("from"))
        at = lambda c: open_.select(F.col("node").alias(c), F.struct("low", "from").alias(f"{c}_key"))  # noqa: B023, E731
        alike = left.join(at("a"), "a").join(at("b"), "b").where(F.col("a_key") == F.col("b_key")).select("a", "b")
        left = cyclic_core(written(alike))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    names = found.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n"))
    return written(found.join(names, "colour").where("n > 1").select("node", "component"))


def longest_paths(edges: DataFrame) -> DataFrame:
    """``node`` and ``depth``, the edges of its longest path to a node without further edges, of an acyclic edge table."""
    edges = written(edges)
    tops = edges.select(F.col("b").alias("node")).union(edges.select("a")).distinct().join(edges.select(F.col("a").alias("node")), "node", "left_anti")
    depth = written(tops.select("node", F.lit(0).cast("long").alias("depth")))
    jumps, turn = Jumps(edges, edges.count()), 0
    while True:
        ways = edges.withColumn("w", F.lit(1).cast("long"))
        if jumps.steps > 1:
            ways = ways.unionByName(jumps.table.withColumn("w", F.lit(jumps.steps).cast("long")))
        sent = ways.join(depth, ways["b"] == depth["node"]).groupBy("a").agg(F.max(F.col("w") + F.col("depth")).alias("sent"))
        old = depth.withColumnRenamed("node", "n")
        new = old.join(sent, old["n"] == sent["a"], "full").select(F.coalesce("n", "a").alias("node"), F.greatest("depth", "sent").alias("depth"), (F.coalesce("depth", F.lit(-1)) < F.col("sent")).alias("rose"))
        new = written(new)
        depth = new.select("node", "depth")
        if not new.where("rose").limit(1).count():
            return depth
        turn += 1
        if turn > 3:  # most hierarchies are done before
            jumps.double()


def depths(parents: DataFrame) -> DataFrame:
    """``node`` and ``depth``, its longest path to a root, from (``child``, ``parent``) pairs.

    Classes that are each other's ancestors count as one place: edges within such a cycle add nothing, all its classes have
    the same depth, and a cycle without parents outside is a root. So a depth never depends on where a walk begins. Pairs
    with a null name a class only; repeated pairs count once.
    """
    named = parents.select("child", "parent")
    nodes = named.select(F.col("child").alias("node")).union(named.select("parent")).where("node is not null").distinct()
    edges = written(named.where("child <> parent").select(F.col("child").alias("a"), F.col("parent").alias("b")).distinct())
    place = strong_components(edges)
    of = lambda c: place.select(F.col("node").alias(c), F.col("component").alias(f"{c}_at"))
    met = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = met.select(F.coalesce("a_at", "a").alias("a"), F.coalesce("b_at", "b").alias("b")).where("a <> b").distinct()
    deep = longest_paths(between).withColumnRenamed("node", "at")
    placed = nodes.join(place, "node", "left").select("node", F.coalesce("component", "node").alias("at"))
    return placed.join(deep, "at", "left").select("node", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))

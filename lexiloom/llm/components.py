"""Connected components of an edge table, by smallest label and pointer jumping.

Edges are first contracted inside their partitions to forests. Each round sends the smaller
label over every edge (a minimum, so it is combined before the shuffle) and then replaces each
label by that label's own; rounds are written to the shared folder. A star or a pair is done in two
rounds, a chain in a number that grows with the logarithm of its length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, stored


class Forest:
    """Union of numbers by smallest root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def contracted(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """An equivalent edge table: each partition's edges as stars (``a`` > ``b``)."""

    def run(frames):
        forest = Forest()
        for pdf in frames:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                forest.join(a, b)
            if len(forest.up) > most:
                yield stars(forest)
                forest = Forest()
        yield stars(forest)

    def stars(forest):
        rows = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    return edges.mapInPandas(lean(run), "a long, b long")


#: Labels whose own labels are broadcast; above it they are joined by salted keys.
MOST, SALT = 200_000, 16


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for the nodes of ``edges`` (a, b).

    Edges with a null are left out; an edge of a node with itself says nothing, so its node is in the result
    only by another edge; repeated edges count once; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    stars = stored(contracted(edges.select("a", "b").where("a is not null and b is not null")).distinct())
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        sent = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        lower = stored(labels.join(sent, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("low")))
        # a large component's label is common, so what it leads to is found once for each label
        parent = lower.select(F.col("node").alias("low"), F.col("low").alias("up"))
        jumps = stored(lower.select("low").distinct().join(parent, "low").where("up < low"))
        if jumps.count() <= MOST:
            jumped = lower.join(F.broadcast(jumps), "low", "left")
        else:
            salted = jumps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            jumped = lower.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALT))).join(salted, ["low", "salt"], "left")
        nxt = stored(jumped.select("node", F.least("low", F.coalesce("up", "low")).alias("component"), "old"))
        changed = nxt.where("component <> old").limit(1).count()
        discard(spark, labels, lower, jumps)
        labels = nxt
        if not changed:
            discard(spark, stars)
            return labels.select("node", "component")

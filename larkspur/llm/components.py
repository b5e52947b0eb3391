"""Distributed connected components by repeated contraction.

Every edge points from a larger to a smaller id.  In a round each node adopts
its smallest neighbour, the resulting forest is flattened by pointer jumping
until every node points to a root, and the edges are rewritten to the roots;
loops and repeats vanish.  A node is absorbed in one round only.  The smallest
node of a component has no smaller neighbour, so it is never absorbed and ends
as the label.  Rounds and jumps grow with the logarithm of the longest path.

Only plain joins and map-side combined minima are used, so a hub that a third
of all edges touch is split by adaptive execution; neither edges nor labels
ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, jumps: int = 2) -> DataFrame:
    """``(node, component)`` of every node that is not its component's smallest, once.

    ``edges`` has two id columns.  Null ends and loops are ignored; an empty
    table gives an empty result.  A node that is absent from the result is the
    smallest of its component (or has no edge): coalesce it to itself.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    live = scratch.keep(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
    )
    forests: list[DataFrame] = []
    while not live.isEmpty():
        parent = live.groupBy("hi").agg(F.min("lo").alias("up")).withColumnRenamed("hi", "node")
        while True:
            for _ in range(jumps):
                above = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
                parent = parent.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
            parent = scratch.keep(parent)
            if parent.join(parent.select(F.col("node").alias("up")), "up", "left_semi").isEmpty():
                break
        forests.append(parent)
        to_lo = parent.select(F.col("node").alias("lo"), F.col("up").alias("lo_up"))
        to_hi = parent.select(F.col("node").alias("hi"), F.col("up").alias("hi_up"))
        moved = live.join(to_lo, "lo", "left").select("hi", F.coalesce("lo_up", "lo").alias("x")).join(to_hi, "hi").select("x", F.col("hi_up").alias("y"))
        left = scratch.keep(moved.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
        scratch.drop(live)
        live = left
    if not forests:
        return live.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    # A node keeps the root it had when it was absorbed; later forests move that root.
    labels = forests[0].select("node", F.col("up").alias("component"))
    for forest in forests[1:]:
        step = forest.select(F.col("node").alias("component"), F.col("up").alias("next"))
        moved = labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        labels = moved.unionByName(forest.select("node", F.col("up").alias("component")))
    return labels

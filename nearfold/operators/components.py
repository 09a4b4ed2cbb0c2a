"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.tables import stored

#: Pointer jumps in a round.
JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that edges (a, b) reach) of all nodes with an edge.

    Every round maps each node to its least neighbour if that is less, follows these steps
    up to `1 << JUMPS` of them, and contracts the graph: nodes stay in their component and
    edges between different images stay, whether or not a step led to the end. All nodes
    but local minima move, so rounds grow with the logarithm of a component's size."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        hooks = stored(hooks, "hooks")
        for _ in range(JUMPS):
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            hooks = hooks.join(up, "root").select("node", F.col("above").alias("root"))
        hooks = stored(hooks, "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("root").alias("component"))
        else:
            up = hooks.select(F.col("node").alias("component"), "root")
            labels = stored(labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        ends = {x: hooks.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"}
        edges = stored(edges.join(ends["a"], "a").join(ends["b"], "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if labels is None else labels

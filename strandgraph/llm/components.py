"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): the smallest node of each component.

    Every round hooks each node to its smallest neighbour, jumps twice along these pointers and contracts the links; no
    step gathers the neighbours of a node or a component in one place. Ends when no link is left; an empty table gives no rows.
    """
    edges = common.materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = common.materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = common.materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "hooks")
        for _ in range(2):
            onward = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hook = hook.join(onward, "to").select("a", F.col("next").alias("to"))
        hook = common.materialize(hook, "hooks")
        moved = hook.select(F.col("a").alias("component"), "to")
        labels = common.materialize(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends = hook.select("a", F.col("to").alias("x"))
        others = hook.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = common.materialize(edges.join(ends, "a").join(others, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels

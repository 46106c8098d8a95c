"""Connected components of a graph of any shape, by contracting neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.durable import materialize


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``links`` (a, b); a component is named by its smallest node.

    Links may repeat, point either way, or join a node with itself; rows with a null end count for nothing, and no
    links give no rows. Each step gives the nodes a new order by hash, merges every node into the first one at most
    two links away, and goes on with the links between merged nodes: a whole component vanishes, long chains become
    shorter by a factor, whatever their numbering. First neighbours are aggregated before the shuffle and joined back
    to the links, so a node with very many links is no task of its own. Every step is written to the shared folder.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = materialize(ends.where("a > b").distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c: F.xxhash64(c, F.lit(len(steps)))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("near"))
        near = near.select(F.col("a").alias("b"), F.when(rank("near") < rank("a"), F.col("near")).otherwise(F.col("a")).alias("near"))
        # a node is a neighbour of its neighbours, so theirs are never later than its own
        step = both.join(near, "b").groupBy("a").agg(F.min_by("near", rank("near")).alias("into"))
        step = materialize(step.withColumnRenamed("a", "node"), "merged")
        steps.append(step)
        one, two = (step.select(F.col("node").alias(x), F.col("into").alias(f"into_{x}")) for x in "ab")
        edges = edges.join(one, "a").join(two, "b").where("into_a <> into_b")
        edges = materialize(edges.select(F.greatest("into_a", "into_b").alias("a"), F.least("into_a", "into_b").alias("b")).distinct(), "links")
    if not steps:
        return nodes.select("node", F.col("node").alias("component"))
    found = steps.pop()
    while steps:
        later = found.select(F.col("node").alias("into"), F.col("into").alias("last"))
        found = steps.pop().join(later, "into", "left").select("node", F.coalesce("last", "into").alias("into"))
    names = found.groupBy("into").agg(F.min("node").alias("component"))
    found = found.join(names, "into").select("node", "component")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))

"""Connected components of a link table, by hanging nodes on smaller neighbours and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import hot_join, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), component being the least node that can be reached.

    Every node takes its least smaller neighbour as parent; parents are followed to the roots, two steps in one; links
    whose ends have different roots are links between roots and go through the same again. Only least neighbours are
    gathered by node, never lists of neighbours, a root that very many nodes have meets them in a broadcast, and every step
    is written out, so neither a node with very many links nor a lost executor stops it.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "edges")
    roots = None  # node, component
    while not edges.isEmpty():
        parent = written(edges.groupBy("u").agg(F.min("v").alias("v")), "parents")
        while True:
            up = parent.select(F.col("u").alias("v"), F.col("v").alias("w"))
            parent = written(hot_join(parent, up, "v").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")), "parents")
            if parent.where("moved").isEmpty():
                break
            parent = parent.drop("moved")
        root = parent.select("u", F.col("v").alias("r"))
        tops = root.select(F.col("r").alias("node")).distinct().select("node", F.col("node").alias("component"))
        own = root.select(F.col("u").alias("node"), F.col("r").alias("component")).unionByName(tops)
        if roots is not None:
            kept = hot_join(roots, own.select(F.col("node").alias("component"), F.col("component").alias("c")), "component").select("node", F.coalesce("c", "component").alias("component"))
            own = kept.unionByName(own.join(kept.select("node"), "node", "left_anti"))
        roots = written(own, "components")
        ends = edges.join(root, "u", "left").select(F.coalesce("r", "u").alias("x"), F.col("v").alias("u")).join(root, "u", "left").select("x", F.coalesce("r", "u").alias("y"))
        edges = written(ends.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

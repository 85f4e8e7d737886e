"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import staged


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Each round every node points at its smallest neighbour, pointers are followed
    twice, and the edges are contracted to edges between what is pointed at. The
    rounds shrink the edge list geometrically; each is staged, so none is done
    again. A hub's neighbours are combined on the map side, and nothing but an
    edge count reaches the driver. Loops and repeated edges do no harm.
    """
    edges = staged(edges.select("a", "b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = staged(nodes.withColumn("component", F.col("node")), "labels")
    left = edges.where("a != b")
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b"))
        parent = staged(up.select("a", F.least("a", "b").alias("p")), "parents")
        for _ in range(2):
            above = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = parent.join(above, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        parent = staged(parent, "parents")
        new = parent.select(F.col("a").alias("component"), "p")
        labels = staged(
            labels.join(new, "component", "left").select("node", F.coalesce("p", "component").alias("component")),
            "labels",
        )
        ends = left.join(parent, "a").select(F.col("p").alias("x"), F.col("b").alias("a"))
        ends = ends.join(parent, "a").select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b"))
        left = staged(ends.where("a != b").distinct(), "edges")
    return labels

"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its smallest node.

    Each round every node points at its smallest neighbour or itself, pointers are followed twice, and
    the edges between what remains are kept. The number of nodes left with edges at least halves, so
    rounds grow with the logarithm. Each round is a written table; no path or component is gathered."""
    edges = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    label = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node")
        for _ in range(2):
            point = stored(point, "point")
            far = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            point = point.join(far, "to").select("node", F.col("next").alias("to"))
        point = stored(point, "point")
        if label is None:
            label = point.withColumnRenamed("to", "component")
        else:
            moved = point.select(F.col("node").alias("component"), "to")
            label = label.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        label = stored(label, "label")
        a = point.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        b = point.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        edges = stored(edges.join(a, "a").join(b, "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return label

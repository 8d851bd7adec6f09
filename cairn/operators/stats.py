"""Reports over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_counts(nodes: DataFrame) -> DataFrame:
    """(repo_id, type, n) of each repository, most common first."""
    return nodes.groupBy("repo_id", "type").agg(F.count(F.lit(1)).alias("n")).orderBy("repo_id", F.desc("n"), "type")


def resolved_edge_report(edges: DataFrame, chars: int = 8) -> DataFrame:
    """(repo_id, source, target_ref, type) of resolved edges, the source's id shortened."""
    return edges.filter("target_id is not null").select("repo_id", F.substring("source_id", 1, chars).alias("source"), "target_ref", "type")

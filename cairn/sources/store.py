"""Keyed tables: inserts, upserts and lookups as joins, stored as Parquet by repository."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import stored

#: Files that a large repository's rows are dealt to when they are committed.
FILES = 8


def first_rows(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The rows to append: the first new row of each key that the table doesn't have."""
    return first_rows(new, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")


def last_rows(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key: the last in ``order``."""
    return first_rows(rows, keys, [(F.col(o) if isinstance(o, str) else o).desc() for o in order])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The table after an upsert: the last new row of each key replaces the old one."""
    last = last_rows(new, keys, order).select(*existing.columns)
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last)


def upsert_repositories(existing: DataFrame, new: DataFrame, now: Column | None = None, order: list[str | Column] | None = None) -> DataFrame:
    """Repositories after an upsert by id: name, path and indexed_at are the new ones. Of an id that a batch
    repeats the last row in ``order`` counts (columns of ``new``; by default the largest name, then path)."""
    last = last_rows(new, ["id"], order or ["name", "path"])
    stamped = last.select("id", "name", "path").withColumn("indexed_at", now if now is not None else F.current_timestamp())
    return existing.join(stamped.select("id"), "id", "left_anti").unionByName(stamped)


def replace_languages(existing: DataFrame, new: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """(repo_id, language): each new repository's set replaces its old one, also by an empty one. Of an id that a
    batch repeats the last set in ``order`` counts (by default the largest)."""
    last = last_rows(new, ["id"], order or ["languages"]).select(F.col("id").alias("repo_id"), "languages")
    kept = existing.join(last.select("repo_id"), "repo_id", "left_anti")
    return kept.unionByName(last.select("repo_id", F.explode(F.array_distinct("languages")).alias("language")))


def upsert_embeddings(existing: DataFrame, new: DataFrame, order: list[str | Column]) -> DataFrame:
    """Chunk 0 of each node (of its repository, where the table names it): text and vector are the last new ones."""
    keys = [k for k in ("repo_id", "node_id", "chunk_index") if k in existing.columns]
    return upsert(existing, new.withColumn("chunk_index", F.lit(0)), keys, order)


def update_summaries(nodes: DataFrame, summaries: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """Nodes with the new summary where there is one; of repeated ones the last in ``order`` (by default the largest)."""
    last = last_rows(summaries, ["repo_id", "id"], order or ["summary"])
    fresh = last.select("repo_id", "id", F.col("summary").alias("_fresh"))
    return nodes.join(fresh, ["repo_id", "id"], "left").withColumn("summary", F.coalesce("_fresh", "summary")).select(*nodes.columns)


def nodes_by_repo(nodes: DataFrame, repo_id: str | None = None) -> DataFrame:
    """Nodes of a repository (or of all) by path, start line and id."""
    rows = nodes if repo_id is None else nodes.filter(F.col("repo_id") == repo_id)
    return rows.orderBy("repo_id", "path", "start_line", "id") if repo_id is None else rows.orderBy("path", "start_line", "id")


def nodes_by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(query_id, node columns) of the ids (query_id, repo_id, id); unknown ids vanish."""
    return ids.select("query_id", "repo_id", "id").distinct().join(nodes, ["repo_id", "id"])


def incident_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with a node (repo_id, id) as source or target; one of both ends or a self-loop comes once."""
    known = ids.select("repo_id", "id").distinct()
    out = [edges.join(known.withColumnRenamed("id", end), ["repo_id", end], "left_semi").select(*edges.columns) for end in ("source_id", "target_id")]
    return out[0].unionByName(out[1]).dropDuplicates(["repo_id", "id"])


def table_by_repo(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A committed table. Its schema is given, so that repository ids stay strings; filters and joins by repo_id
    read the partitions they name alone."""
    return spark.read.schema(schema).parquet(path)


def commit_by_repo(rows: DataFrame, path: str) -> None:
    """Puts ``rows`` in the place of their repositories' partitions; other repositories stay as they are.

    Rows are staged in the shared folder first, so they may come from the very table, and are then swapped in
    partition by partition when all are written. A task that fails or is run twice leaves nothing behind."""
    staged = stored(rows, "staged")
    staged.repartition("repo_id", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "repo_id"][:1]), F.lit(FILES))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def change_by_repo(path: str, schema: T.StructType | str, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Commits ``change(existing, new)``, where existing rows are those of the repositories that ``new`` names; no
    other partition is read or written. A repository that is left without rows keeps its old ones."""
    touched = new.select("repo_id").distinct()
    existing = table_by_repo(new.sparkSession, path, schema).join(touched, "repo_id", "left_semi")
    commit_by_repo(change(existing, new), path)

"""From a batch of questions to prompts: hybrid search, expansion and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .context import MAX_CHARS, expand_and_prompt
from .search import hybrid_search, search_documents


def retrieve_context(queries: DataFrame, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, k: int = 5, depth: int = 2, max_chars: int = MAX_CHARS) -> DataFrame:
    """(query_id, prompt, tier) of queries (query_id, text, embedding)."""
    best = stored(hybrid_search(search_documents(nodes), embeddings, queries, k).select("query_id", F.col("node_id").alias("id"), "rank"), "best")
    where = nodes.select("id", "repo_id").join(best.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("repo_id").alias("repo_id"))
    return expand_and_prompt(queries, best.join(where, "id"), nodes, edges, depth, max_chars)

"""Queries of the code-graph and retrieval operators, and SQL that must give the same rows."""

from .plans import enrichment, graph_build, retrieval

QUERIES = graph_build.QUERIES | enrichment.QUERIES | retrieval.QUERIES
ORACLE_SQL = graph_build.ORACLE_SQL | enrichment.ORACLE_SQL | retrieval.ORACLE_SQL
FLAGSHIP = QUERIES["p7_retrieve_context"]

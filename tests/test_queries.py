"""A few registered queries against their SQL at the smallest size, and the entry."""

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["s1_read_sources", "s3_commit_by_repo", "i4_node_blocks", "x5_functions", "x9_calls", "r5_resolve_edges", "s9_incident_edges", "q4_bm25_search", "q7_hybrid_search", "g2_subgraph_edges", "p5_build_prompts", "i5_summary_batches"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in "documents embeddings benchmark region nation customer supplier part orders lineitem".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), c.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).map(lambda x: float(x) if isinstance(x, int) else x).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "prompt", "tier"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

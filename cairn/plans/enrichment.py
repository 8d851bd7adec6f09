"""Queries of summaries and embeddings."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich as I
from ..operators import extract as X
from ..sources.shared import stored
from . import fixtures as fx
from .fixtures import frame, plain

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = plain(sql)
        return fn

    return add


DOCS = f"({fx.DOC_NODES})"
_TEXT = "concat(qualified_name, chr(10), chr(10), 'Summary: ', coalesce(summary, ''), chr(10), chr(10))"
_CUT = f"concat({_TEXT}, substring(coalesce(raw_source, ''), 1, greatest(0, 6000 - length({_TEXT}))))"
_PAD = "chr(10), '        '"


def _block(index: str, meta: str = "''") -> str:
    return f"concat('### NODE ', cast({index} AS string), {_PAD}, 'ID: ', id, {_PAD}, 'Name: ', qualified_name, {_PAD}, 'Type: ', type, {_PAD}, 'Meta: ', {meta}, {_PAD}, 'Code:', {_PAD}, raw_source)"


_ORDER = "list_transform(string_split(path, '/'), lambda p, i: concat(CASE WHEN i = len(string_split(path, '/')) THEN '0' ELSE '1' END, p))"
_NUMBERED = f"SELECT *, cast(row_number() OVER (PARTITION BY repo_id ORDER BY {_ORDER}, node_seq, start_line, id) - 1 AS int) AS idx FROM {DOCS} WHERE type <> 'module' AND raw_source IS NOT NULL AND raw_source <> ''"
_BLOCKS = f"SELECT *, cast(ceil(length({_block('idx')}) / 4.0) AS int) AS tokens FROM ({_NUMBERED})"
#: Greedy packing as a walk from node to node.
_PACKED = f"""RECURSIVE b AS ({_BLOCKS}), pack AS (
  SELECT repo_id, id, idx, tokens, 0 AS batch_no, 1 AS n, 311 + tokens AS total FROM b WHERE idx = 0
  UNION ALL SELECT b.repo_id, b.id, b.idx, b.tokens, CASE WHEN full_ THEN batch_no + 1 ELSE batch_no END, CASE WHEN full_ THEN 1 ELSE n + 1 END, CASE WHEN full_ THEN 311 + b.tokens ELSE total + b.tokens END
  FROM (SELECT p.repo_id, p.idx + 1 AS nxt, p.batch_no, p.n, p.total, p.n >= 20 OR p.total + c.tokens > 50000 AS full_ FROM pack p JOIN b c ON c.repo_id = p.repo_id AND c.idx = p.idx + 1) s JOIN b ON b.repo_id = s.repo_id AND b.idx = s.nxt)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("struct<meta:string>")
    return frame(spark, d, fx.DOC_NODES).withColumn("attributes", none)


@query("i1_eligible_nodes", f"SELECT repo_id, id FROM {DOCS} WHERE type <> 'module' AND raw_source IS NOT NULL")
def i1(spark: SparkSession, d: str) -> DataFrame:
    return I.eligible_nodes(frame(spark, d, fx.DOC_NODES)).select("repo_id", "id")


@query("i2_embedding_documents", f"SELECT repo_id, id AS node_id, cast(0 AS int) AS chunk_index, {_CUT} AS chunk_text FROM {DOCS} WHERE type <> 'module' AND raw_source IS NOT NULL")
def i2(spark: SparkSession, d: str) -> DataFrame:
    return I.embedding_documents(frame(spark, d, fx.DOC_NODES))


@query("i3_estimate_tokens", "SELECT doc_id, cast(ceil(length(text) / 4.0) AS int) AS tokens FROM documents")
def i3(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.tables(spark, d, ["documents"])["documents"]
    return docs.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("i4_node_blocks", f"SELECT repo_id, id, idx AS index, {_block('idx')} AS block, tokens FROM ({_BLOCKS})")
def i4(spark: SparkSession, d: str) -> DataFrame:
    return I.node_blocks(_nodes(spark, d)).select("repo_id", "id", "index", "block", "tokens")


@query(
    "i4_node_meta",
    f"""SELECT repo_id, qualified_name, CASE WHEN type = 'class' THEN CASE WHEN kind = 'pkg' THEN 'Inherits from: nothing' WHEN kind = 'sup' THEN concat('Inherits from: [''Base', cast(n AS string), ''']') ELSE 'Inherits from: [''Shared'']' END
    WHEN kind = 'sup' AND name = 'run' THEN 'Args: {{''self'': None, ''x'': ''int'', ''kw'': None}} | Returns: int' WHEN kind = 'sup' AND name LIKE 'local%' THEN 'Args: {{''a'': None, ''args'': None, ''b'': ''str''}} | Returns: None'
    WHEN name IN ('run', 'step') THEN 'Args: {{''self'': None}} | Returns: None' WHEN kind = 'cust' THEN 'Args: {{''a'': None}} | Returns: None' ELSE 'Args: {{''x'': None}} | Returns: None' END AS meta FROM ({fx.EXPECTED_NODES}) WHERE type <> 'module'""",
)
def i4_meta(spark: SparkSession, d: str) -> DataFrame:
    nodes = X.nodes_of(X.extract(frame(spark, d, fx.SOURCES)))
    return I.eligible_nodes(nodes, for_summary=True).select("repo_id", "qualified_name", F.col("attributes.meta").alias("meta"))


@query("i5_summary_batches", f"WITH {_PACKED} SELECT repo_id, id, idx AS index, tokens, cast(batch_no AS int) AS batch_no FROM pack")
def i5(spark: SparkSession, d: str) -> DataFrame:
    return I.summary_batches(I.node_blocks(_nodes(spark, d)))


_PROMPT_SQL = f"""WITH {_PACKED}, f AS (SELECT repo_id, batch_no, min(idx) AS lo FROM pack GROUP BY ALL), r AS (SELECT p.repo_id, p.batch_no, p.idx, p.tokens, b.id, b.qualified_name, b.type, b.raw_source, p.idx - f.lo AS pos FROM pack p JOIN f USING (repo_id, batch_no) JOIN b ON b.repo_id = p.repo_id AND b.id = p.id),
pr AS (SELECT repo_id, cast(batch_no AS int) AS batch_no, concat('{I.INSTRUCTION.strip()}', chr(10), chr(10), string_agg({_block('pos')}, concat(chr(10), chr(10)) ORDER BY pos)) AS prompt, count(*) AS n_nodes, sum(tokens) AS tokens FROM r GROUP BY repo_id, batch_no)"""


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    blocks = stored(I.node_blocks(_nodes(spark, d)), "blocks")
    return I.summary_prompts(blocks, I.summary_batches(blocks))


@query("i6_summary_prompts", _PROMPT_SQL + " SELECT repo_id, batch_no, prompt, n_nodes, cast(tokens AS bigint) AS tokens FROM pr")
def i6(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d)


_ANSWERS = f"SELECT repo_id, cast(start_line % 3 AS int) AS batch_no, CASE WHEN start_line % 11 = 0 THEN '' WHEN start_line % 11 = 1 THEN '[{{' ELSE concat('[{{\"id\": \"', id, '\", \"summary\": \"first\"}}, {{\"id\": \"', id, '\", \"summary\": \"says ', name, '\"}}]') END AS response FROM {DOCS}"


@query("i7_parse_summaries", f"SELECT repo_id, id, concat('says ', name) AS summary FROM {DOCS} WHERE start_line % 11 > 1 UNION ALL SELECT repo_id, 'rejected', cast(count(*) AS string) FROM {DOCS} WHERE start_line % 11 = 1 GROUP BY repo_id")
def i7(spark: SparkSession, d: str) -> DataFrame:
    text = frame(spark, d, fx.DOC_NODES)
    good = F.concat(F.lit('[{"id": "'), "id", F.lit('", "summary": "first"}, {"id": "'), "id", F.lit('", "summary": "says '), "name", F.lit('"}]'))
    made = F.when(F.col("start_line") % 11 == 0, "").when(F.col("start_line") % 11 == 1, "[{").otherwise(good)
    summaries, rejects = I.parse_summaries(text.select("repo_id", (F.col("start_line") % 3).alias("batch_no"), made.alias("response")))
    return summaries.unionByName(rejects.groupBy("repo_id").agg(F.count(F.lit(1)).cast("string").alias("n")).select("repo_id", F.lit("rejected").alias("id"), F.col("n").alias("summary")))


def _fake(prompts: list[str]) -> list[str]:
    """A model that names each node it is shown."""
    return [json.dumps([{"id": i, "summary": f"Node {n}"} for i, n in re.findall(r"^ {8}ID: (.*)\n {8}Name: (.*)$", p, re.M)]) for p in prompts]


@query("i8_summarize", f"SELECT repo_id, id, concat('Node ', qualified_name) AS summary FROM ({_NUMBERED})")
def i8(spark: SparkSession, d: str) -> DataFrame:
    summaries, _ = I.parse_summaries(I.call_model(_prompts(spark, d), _fake))
    return summaries


@query("i9_embed", f"SELECT repo_id, id AS node_id, cast(0 AS int) AS chunk_index, len(list_filter(string_split_regex({_CUT}, '" + fx.SPACES + f"'), lambda x: x <> '')) AS total FROM {DOCS} WHERE type <> 'module' AND raw_source IS NOT NULL")
def i9(spark: SparkSession, d: str) -> DataFrame:
    """The test embedder counts tokens, so a vector's sum is the number of tokens."""
    made = I.embed(I.embedding_documents(frame(spark, d, fx.DOC_NODES)), I.hashing_embedder())
    return made.select("repo_id", "node_id", "chunk_index", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))


@query("i10_index_stats", f"SELECT repo_id, count(*) AS nodes_processed, count(CASE WHEN start_line % 2 = 0 THEN 1 END) AS summaries_generated, count(CASE WHEN start_line % 3 <> 0 THEN 1 END) AS embeddings_stored FROM {DOCS} WHERE type <> 'module' AND raw_source IS NOT NULL GROUP BY repo_id")
def i10(spark: SparkSession, d: str) -> DataFrame:
    nodes = frame(spark, d, fx.DOC_NODES)
    embeddings = nodes.select("repo_id", F.col("id").alias("node_id"), F.when(F.col("start_line") % 3 != 0, F.array(F.lit(1.0))).alias("embedding"))
    return I.index_stats(nodes, nodes.filter("start_line % 2 = 0").select("repo_id", "id", "summary"), embeddings)

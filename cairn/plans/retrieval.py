"""Queries of search, graph expansion and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as P
from ..operators import graph as G
from ..operators import search as S
from ..operators.enrich import call_model
from ..operators.retrieve import retrieve_context
from . import fixtures as fx
from .fixtures import frame, plain

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        ORACLE_SQL[name] = plain(sql)
        return fn

    return add


K = 10
GN, GE = f"({fx.GRAPH_NODES})", f"({fx.GRAPH_EDGES})"
_TOKENS = "list_filter(string_split_regex(lower(text), '" + fx.SPACES + "'), lambda x: x <> '')"
_DOCS = "SELECT repo_id, id AS node_id, path, start_line, concat(qualified_name, chr(10), chr(10), 'Summary: ', coalesce(summary, ''), chr(10), chr(10), coalesce(raw_source, '')) AS text FROM ({nodes}) n WHERE type IN ('function', 'class')".replace("{nodes}", fx.DOC_NODES)


def _bm25(queries: str, k: int, scope: bool = False) -> str:
    """BM25 with its floor and zero fill, as common table expressions ending in ``bm25``."""
    s, on = ("repo_id, ", "USING (repo_id)") if scope else ("", "ON true")
    return f"""
docs AS ({_DOCS}), toks AS (SELECT repo_id, node_id, path, start_line, {_TOKENS} AS t FROM docs),
tf AS (SELECT repo_id, node_id, len(t) AS dl, term, count(*) AS f FROM (SELECT repo_id, node_id, t, unnest(t) AS term FROM toks) GROUP BY ALL),
corpus AS (SELECT {s}count(*) AS n, avg(len(t)) AS avgdl FROM toks {"GROUP BY repo_id" if scope else ""}),
raw AS (SELECT {s}term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT {s}term, count(*) AS df FROM tf GROUP BY {s}term) x JOIN corpus {on}),
idf AS (SELECT {s}term, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw JOIN (SELECT {s}avg(r) AS m FROM raw {"GROUP BY repo_id" if scope else ""}) y {on}),
q AS ({queries}), qt AS (SELECT {s}query_id, term, count(*) AS qf FROM (SELECT {s}query_id, unnest({_TOKENS}) AS term FROM q) GROUP BY ALL),
hits AS (SELECT {"tf.repo_id, " if scope else ""}query_id, node_id, round(sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
         FROM tf JOIN idf USING ({s}term) JOIN qt USING ({s}term) JOIN corpus {on} GROUP BY ALL),
alls AS (SELECT a.query_id, d.node_id, d.path, d.start_line, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT {s}query_id FROM qt) a JOIN docs d {on} LEFT JOIN hits h ON h.query_id = a.query_id AND h.node_id = d.node_id),
bm25 AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start_line, node_id) AS rank FROM alls QUALIFY rank <= {k})"""


def _vector(queries: str, k: int) -> str:
    return f"""
vq AS ({queries}), v AS ({fx.VECTORS}),
near AS (SELECT query_id, node_id, round(list_cosine_distance(cast(vq.embedding AS double[]), cast(v.embedding AS double[])), 6) AS distance FROM vq, v),
vec AS (SELECT query_id, node_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rank FROM near QUALIFY rank <= {k})"""


def _hybrid(k: int) -> str:
    return f"""{_bm25(fx.HYBRID_QUERIES, k)}, {_vector(fx.HYBRID_QUERIES, k)},
lists AS (SELECT query_id, node_id, 0 AS l, rank FROM bm25 UNION ALL SELECT query_id, node_id, 1, rank FROM vec),
fused AS (SELECT query_id, node_id, round(sum(1.0 / (60 + rank - 1)), 12) AS score, min(l * 1000000 + rank) AS first FROM lists GROUP BY ALL),
hybrid AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, node_id) AS rank FROM fused QUALIFY rank <= {k})"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return S.search_documents(frame(spark, d, fx.DOC_NODES))


@query("q1_search_documents", _DOCS)
def q1(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d)


@query("q2_tokenize", f"SELECT node_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens FROM (SELECT node_id, {_TOKENS} AS t FROM ({_DOCS}))")
def q2(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("node_id", T.tokenize(F.col("text")).alias("t"))
    return rows.select("node_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


@query("q3_bm25_index", f"WITH {_bm25(fx.TEXT_QUERIES, K)} SELECT term, round(idf, 6) AS idf, df, n FROM idf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term), corpus")
def q3(spark: SparkSession, d: str) -> DataFrame:
    _, terms = S.bm25_stats(_docs(spark, d))
    return terms.select("term", F.round("idf", 6).alias("idf"), "df", "n")


@query("q4_bm25_search", f"WITH {_bm25(fx.TEXT_QUERIES, K)} SELECT * FROM bm25")
def q4(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25_search(_docs(spark, d), frame(spark, d, fx.TEXT_QUERIES), K)


_SCOPED = "SELECT concat('r', cast(item_id % 4 AS string)) AS repo_id, item_id AS query_id, text FROM {benchmark}"


@query("q4_bm25_search_by_repo", f"WITH {_bm25(_SCOPED, K, scope=True)} SELECT * FROM bm25")
def q4_repo(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25_search(_docs(spark, d), frame(spark, d, _SCOPED), K, scope=["repo_id"])


@query("q5_vector_search", f"WITH {_vector(fx.VECTOR_QUERIES, K)} SELECT * FROM vec")
def q5(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_search(frame(spark, d, fx.VECTORS), frame(spark, d, fx.VECTOR_QUERIES), K)


_MADE = f"WITH {_vector(fx.HYBRID_QUERIES, K)}, back AS (SELECT query_id, node_id, {K + 1} - rank AS rank FROM vec), lists AS (SELECT query_id, node_id, 0 AS l, rank FROM vec UNION ALL SELECT query_id, node_id, 1, rank FROM back), fused AS (SELECT query_id, node_id, round(sum(1.0 / (60 + rank - 1)), 12) AS score, min(l * 1000000 + rank) AS first FROM lists GROUP BY ALL) SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, node_id) AS rank FROM fused QUALIFY rank <= {K}"


@query("q6_rrf_fuse", _MADE)
def q6(spark: SparkSession, d: str) -> DataFrame:
    """A ranking fused with its reverse: all sums meet in the middle, so ties matter."""
    one = S.vector_search(frame(spark, d, fx.VECTORS), frame(spark, d, fx.HYBRID_QUERIES), K)
    return S.rrf_fuse([one, one.withColumn("rank", F.lit(K + 1) - F.col("rank"))], K)


@query("q7_hybrid_search", f"WITH {_hybrid(K)} SELECT * FROM hybrid")
def q7(spark: SparkSession, d: str) -> DataFrame:
    return S.hybrid_search(_docs(spark, d), frame(spark, d, fx.VECTORS), frame(spark, d, fx.HYBRID_QUERIES), K)


@query("q8_label_results", f"WITH {_vector(fx.VECTOR_QUERIES, K)} SELECT query_id, vec.node_id, distance, rank, n.qualified_name, n.type FROM vec LEFT JOIN ({fx.DOC_NODES}) n ON n.id = vec.node_id")
def q8(spark: SparkSession, d: str) -> DataFrame:
    return S.label_results(q5(spark, d), frame(spark, d, fx.DOC_NODES))


_REACH = f"""RECURSIVE seeds AS ({fx.GRAPH_SEEDS}), e AS (SELECT * FROM {GE} WHERE target_id IS NOT NULL), both_ AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e),
walk AS (SELECT DISTINCT query_id, id, 0 AS level FROM seeds UNION SELECT query_id, b, level + 1 FROM walk JOIN both_ ON a = id WHERE level < 2),
found AS (SELECT query_id, id, min(level) AS level FROM walk GROUP BY ALL)"""


def _found(spark: SparkSession, d: str) -> tuple[G.Reach, DataFrame]:
    edges = frame(spark, d, fx.GRAPH_EDGES)
    return G.reach(frame(spark, d, fx.GRAPH_SEEDS), edges, 2), edges


@query("g1_subgraph_nodes", f"WITH {_REACH} SELECT query_id, 'g' AS repo_id, id, level FROM found")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return G.found_nodes(_found(spark, d)[0])


@query("g2_subgraph_edges", f"WITH {_REACH} SELECT f.query_id, e.repo_id, e.id, e.source_id, e.target_id, e.type FROM e JOIN found f ON f.id = e.source_id JOIN found t ON t.query_id = f.query_id AND t.id = e.target_id")
def g2(spark: SparkSession, d: str) -> DataFrame:
    found, edges = _found(spark, d)
    return G.reached_edges(found, edges.select("repo_id", "id", "source_id", "target_id", "type")).select("query_id", "repo_id", "id", "source_id", "target_id", "type")


@query("g3_subgraph", f"WITH {_REACH} SELECT query_id, level, n.repo_id, n.id, n.qualified_name, n.type FROM found JOIN {GN} n ON n.id = found.id")
def g3(spark: SparkSession, d: str) -> DataFrame:
    nodes = frame(spark, d, fx.GRAPH_NODES).select("repo_id", "id", "qualified_name", "type")
    found = G.reach(frame(spark, d, fx.GRAPH_SEEDS), frame(spark, d, fx.GRAPH_EDGES), 2)
    return G.labelled_nodes(found, nodes).select("query_id", "level", "repo_id", "id", "qualified_name", "type")


def _context(reach: str) -> str:
    """After ``found`` and ``seeds``: the context and its blocks."""
    return f"""{reach}, gn AS (SELECT * FROM {GN}),
ctx AS (SELECT query_id, 'PRIMARY' AS role, row_number() OVER (PARTITION BY query_id ORDER BY rank, n.id) AS pos, n.* FROM seeds s JOIN gn n ON n.id = s.id
        UNION ALL SELECT query_id, 'RELATED', row_number() OVER (PARTITION BY query_id ORDER BY level, path, start_line, n.id), n.* FROM found f JOIN gn n ON n.id = f.id WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = f.query_id AND s.id = f.id)),
ed AS (SELECT f.query_id, e.* FROM e JOIN found f ON f.id = e.source_id JOIN found t ON t.query_id = f.query_id AND t.id = e.target_id)"""


_TRIM = "regexp_replace(raw_source, '" + fx.SPACES + "$', '')"
_LINES15 = "array_to_string(list_slice(string_split_regex(raw_source, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), 1, 15), chr(10))"
_BLOCK = "concat('> ', qualified_name, ' (', type, ')', chr(10), 'Summary: ', coalesce(nullif(summary, ''), 'N/A'), chr(10), {}, chr(10), '---')"
_REL = """rel AS (SELECT ed.query_id, string_agg(concat(s.qualified_name, ' --[', ed.type, ']--> ', coalesce(nullif(ed.target_ref, ''), ed.target_id)), chr(10) ORDER BY s.qualified_name, ed.type, coalesce(nullif(ed.target_ref, ''), ed.target_id), ed.id) AS relationships
        FROM ed JOIN ctx s ON s.query_id = ed.query_id AND s.id = ed.source_id LEFT JOIN ctx t ON t.query_id = ed.query_id AND t.id = ed.target_id WHERE s.type <> 'module' AND (t.type IS NULL OR t.type <> 'module') GROUP BY 1)"""


def _prompts(budget: int) -> str:
    made = lambda p, r: f"concat('=== CODE CONTEXT ===', chr(10), chr(10), '[PRIMARY]', chr(10), coalesce({p} || chr(10), ''), chr(10), '[RELATED]', chr(10), coalesce({r} || chr(10), ''), chr(10), '[RELATIONSHIPS]', chr(10), coalesce(relationships, ''), chr(10), chr(10), '=== QUESTION ===', chr(10), text)"
    agg = lambda role, c: f"string_agg({c}, chr(10) ORDER BY pos) FILTER (role = '{role}')"
    return f"""{_REL}, blocks AS (SELECT query_id, role, pos, {_BLOCK.format(_TRIM)} AS f, {_BLOCK.format("''")} AS b, {_BLOCK.format(f"regexp_replace({_LINES15}, '" + fx.SPACES + "$', '')")} AS c FROM ctx WHERE type <> 'module'),
parts AS (SELECT query_id, {agg('PRIMARY', 'f')} AS p, {agg('PRIMARY', 'c')} AS pc, {agg('RELATED', 'f')} AS r, {agg('RELATED', 'b')} AS rb FROM blocks GROUP BY query_id),
three AS (SELECT query_id, {made('p', 'r')} AS p0, {made('p', 'rb')} AS p1, {made('pc', 'rb')} AS p2 FROM asked LEFT JOIN parts USING (query_id) LEFT JOIN rel USING (query_id)),
prompts AS (SELECT query_id, CASE WHEN length(p0) <= {budget} THEN p0 WHEN length(p1) <= {budget} THEN p1 ELSE p2 END AS prompt, cast(CASE WHEN length(p0) <= {budget} THEN 0 WHEN length(p1) <= {budget} THEN 1 ELSE 2 END AS int) AS tier FROM three)"""


@query("p1_context_nodes", f"WITH {_context(_REACH)} SELECT query_id, role, pos, repo_id, id, qualified_name, type FROM ctx")
def p1(spark: SparkSession, d: str) -> DataFrame:
    seeds = frame(spark, d, fx.GRAPH_SEEDS)
    nodes = frame(spark, d, fx.GRAPH_NODES).select("repo_id", "id", "qualified_name", "type", "path", "start_line")
    return P.context_of(seeds, G.reach(seeds, frame(spark, d, fx.GRAPH_EDGES), 2), nodes).select("query_id", "role", "pos", "repo_id", "id", "qualified_name", "type")


@query("p2_render_node_block", f"SELECT id, {_BLOCK.format(_TRIM)} AS block FROM ({fx.DOC_NODES})")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, fx.DOC_NODES).select("id", P.render_node_block(F.col("qualified_name"), F.col("type"), F.col("summary"), F.col("raw_source")).alias("block"))


@query("p3_render_relationships", f"WITH {_context(_REACH)}, {_REL} SELECT query_id, relationships FROM rel")
def p3(spark: SparkSession, d: str) -> DataFrame:
    found, edges = _found(spark, d)
    return P.reached_relationships(found, frame(spark, d, fx.GRAPH_NODES), edges)


@query("p4_truncate_lines", f"SELECT id, {_LINES15.replace(', 1, 15)', ', 1, 3)')} AS cut FROM ({fx.DOC_NODES})")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, fx.DOC_NODES).select("id", T.first_lines(F.col("raw_source"), 3).alias("cut"))


_ASKED = "asked AS (SELECT s_suppkey AS query_id, concat('What does ', s_name, ' do?') AS text FROM {supplier} WHERE s_suppkey % 20 = 0)"


@query("p5_build_prompts", f"WITH {_context(_REACH)}, {_ASKED}, {_prompts(20_000)} SELECT query_id, prompt, tier FROM prompts")
def p5(spark: SparkSession, d: str) -> DataFrame:
    asked = fx.tables(spark, d, ["supplier"])["supplier"].filter("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("What does "), "s_name", F.lit(" do?")).alias("text"))
    return P.expand_and_prompt(asked, frame(spark, d, fx.GRAPH_SEEDS), frame(spark, d, fx.GRAPH_NODES), frame(spark, d, fx.GRAPH_EDGES), 2)


#: The documents as a graph: each is defined by the module of its tens and calls the next document of its source.
DOC_EDGES = """
SELECT e.repo_id, sha1(concat(source_id, ':', target_id, ':', kind)) AS id, source_id, target_id, cast(NULL AS string) AS target_ref, kind AS type
FROM (SELECT 'all' AS repo_id, cast(lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS string) AS source_id, cast(doc_id AS string) AS target_id, 'calls' AS kind FROM {documents}
      UNION ALL SELECT 'all', cast(doc_id - doc_id % 10 AS string), cast(doc_id AS string), 'defines' FROM {documents} WHERE doc_id % 10 > 0) e WHERE source_id IS NOT NULL
"""
ALL_NODES = fx.DOC_NODES.replace("concat('r', cast(doc_id % 4 AS string)) AS repo_id", "'all' AS repo_id")
_P7_REACH = f"""RECURSIVE {_hybrid(5)}, seeds AS (SELECT query_id, 'all' AS repo_id, node_id AS id, rank FROM hybrid WHERE node_id IN (SELECT cast(doc_id AS string) FROM {{documents}})), e AS (SELECT * FROM ({DOC_EDGES})), both_ AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e),
walk AS (SELECT DISTINCT query_id, id, 0 AS level FROM seeds UNION SELECT query_id, b, level + 1 FROM walk JOIN both_ ON a = id WHERE level < 2),
found AS (SELECT query_id, id, min(level) AS level FROM walk GROUP BY ALL)"""
_P7 = f"WITH {_context(_P7_REACH).replace(GN, f'({ALL_NODES})')}, asked AS (SELECT query_id, text FROM ({fx.HYBRID_QUERIES}) h), {_prompts(20_000)} SELECT query_id, prompt, tier FROM prompts"


@query("p7_retrieve_context", _P7)
def p7(spark: SparkSession, d: str) -> DataFrame:
    return retrieve_context(frame(spark, d, fx.HYBRID_QUERIES), frame(spark, d, ALL_NODES), frame(spark, d, DOC_EDGES), frame(spark, d, fx.VECTORS), k=5, depth=2)


def _echo(prompts: list[str]) -> list[str]:
    return [f"  {len(p)} characters\n" for p in prompts]


@query("p6_answer", _P7.replace("SELECT query_id, prompt, tier FROM prompts", "SELECT query_id, concat(cast(length(prompt) AS string), ' characters') AS answer FROM prompts"))
def p6(spark: SparkSession, d: str) -> DataFrame:
    return call_model(p7(spark, d), _echo, out="answer").select("query_id", "answer")

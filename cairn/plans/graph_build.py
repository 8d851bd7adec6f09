"""Queries of reading, extraction, resolution and storage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import extract as X
from ..operators import resolve as R
from ..sources import files, store
from ..sources.shared import shared_folder, stored
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


NODES, EDGES = f"({fx.EXPECTED_NODES})", f"({fx.EXPECTED_EDGES})"
DOCS, SOURCES = f"({fx.DOC_NODES})", f"({fx.SOURCES})"
GN, GE = f"({fx.GRAPH_NODES})", f"({fx.GRAPH_EDGES})"


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return X.extract(frame(spark, d, fx.SOURCES))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the generated files, extracted once."""
    e = stored(_extracted(spark, d), "extracted")
    return X.nodes_of(e), X.edges_of(e)


# ---- sources ----


@query("s1_read_sources", f"SELECT repo_id, path, source FROM {SOURCES}")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """Writes the generated files to the shared folder, then reads them as a repository each."""
    root = os.path.join(shared_folder(spark).removeprefix("file:").replace("//", "/"), f"cairn-files-{uuid.uuid4().hex}")

    def write(batches):
        for batch in batches:
            for repo, path, source in zip(batch.repo_id, batch.path, batch.source):
                at = os.path.join(root, repo, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8", newline="") as f:
                    f.write(source)
            yield batch[["repo_id"]]

    repos = stored(frame(spark, d, fx.SOURCES).mapInPandas(write, "repo_id string"), "written").distinct()
    return files.read_repositories(repos.withColumn("root", F.concat(F.lit(root + "/"), "repo_id")))


@query(
    "s2_select_parseable",
    f"SELECT repo_id, path, source, 'python' AS language FROM (SELECT repo_id, CASE WHEN path LIKE 'cust%' THEN replace(path, '.py', '.PYW') WHEN path LIKE 'pkg%' THEN replace(path, '.py', '.txt') ELSE path END AS path, source FROM {SOURCES}) WHERE path NOT LIKE '%.txt'",
)
def s2(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, fx.SOURCES)
    moved = F.when(F.col("path").startswith("cust"), F.regexp_replace("path", r"\.py$", ".PYW")).when(F.col("path").startswith("pkg"), F.regexp_replace("path", r"\.py$", ".txt")).otherwise(F.col("path"))
    blank = rows.limit(0).unionByName(rows.select("repo_id", F.concat(F.lit("blank/"), "path").alias("path"), F.lit(" \n\t　").alias("source")))
    return files.select_parseable(rows.withColumn("path", moved).unionByName(blank))


# ---- extraction ----


@query("x1_module_name", f"SELECT DISTINCT path, module FROM {NODES}")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, fx.SOURCES).select("path", keys.module_name(F.col("path")).alias("module")).distinct()


@query("x2_keys", f"SELECT repo_id, id, 'node' AS kind FROM {NODES} UNION ALL SELECT repo_id, id, 'edge' FROM {EDGES} WHERE type <> 'imports'")
def x2(spark: SparkSession, d: str) -> DataFrame:
    """Keys recomputed natively from the extracted columns."""
    nodes, edges = _graph(spark, d)
    n = nodes.select("repo_id", keys.node_id(F.col("repo_id"), F.col("path"), F.col("qualified_name"), F.col("start_line")).alias("id"), F.lit("node").alias("kind"))
    target = F.when(F.col("type") == "defines", F.col("target_id")).otherwise(F.col("target_ref"))
    e = edges.filter("type <> 'imports'").select("repo_id", keys.edge_id(F.col("source_id"), target, F.col("type")).alias("id"), F.lit("edge").alias("kind"))
    return n.unionByName(e)


_NODE = "repo_id, id, name, type, path, qualified_name, start_line, end_line"
for _n, _kind in (("x3_modules", "module"), ("x4_classes", "class"), ("x5_functions", "function")):

    @query(_n, f"SELECT {_NODE} FROM {NODES} WHERE type = '{_kind}'")
    def x345(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        return X.nodes_of(_extracted(spark, d), kind).select(*_NODE.split(", "))


@query(
    "x6_args",
    f"""SELECT repo_id, qualified_name, CASE WHEN kind = 'sup' AND name = 'run' THEN 'self,x:int,kw' WHEN kind = 'sup' AND name LIKE 'local%' THEN 'a,args,b:str' WHEN name IN ('run', 'step') THEN 'self' WHEN kind = 'cust' THEN 'a' ELSE 'x' END AS args,
    CASE WHEN kind = 'sup' AND name = 'run' THEN 'int' END AS returns, CASE WHEN kind = 'sup' AND name = 'run' THEN 'staticmethod' ELSE '' END AS decorators, false AS is_async FROM {NODES} WHERE type = 'function'""",
)
def x6(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("attributes")
    shown = F.array_join(F.transform(a["arg_names"], lambda n: F.concat(n, F.coalesce(F.concat(F.lit(":"), F.element_at(a["args"], n)), F.lit("")))), ",")
    return X.nodes_of(_extracted(spark, d), "function").select("repo_id", "qualified_name", shown.alias("args"), a["returns"].alias("returns"), F.array_join(a["decorators"], ",").alias("decorators"), a["is_async"].alias("is_async"))


@query("x7_defines", f"SELECT repo_id, source_id, target_id FROM {EDGES} WHERE type = 'defines'")
def x7(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _graph(spark, d)
    return X.defines_of(nodes)


@query("x8_inherits", f"SELECT repo_id, source_id, target_ref, path AS source_file FROM {EDGES} WHERE type = 'inherits'")
def x8(spark: SparkSession, d: str) -> DataFrame:
    return X.inherits_of(X.nodes_of(_extracted(spark, d), "class"))


@query("x9_calls", f"SELECT repo_id, id, source_id, target_ref FROM {EDGES} WHERE type = 'calls'")
def x9(spark: SparkSession, d: str) -> DataFrame:
    return X.edges_of(_extracted(spark, d), "calls").select("repo_id", "id", "source_id", "target_ref")


_BINDINGS = "CASE WHEN target_ref = 'json' THEN 'json' ELSE concat('Base', substring(target_ref, 6), ',helper_', substring(target_ref, 6), '=h,*') END"


@query("x10_imports", f"SELECT repo_id, id, source_id, target_ref, {_BINDINGS} AS bindings, false AS is_relative, cast(0 AS int) AS level FROM {EDGES} WHERE type = 'imports'")
def x10(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("attributes")
    shown = F.array_join(F.transform(a["bindings"], lambda b: F.concat(b["name"], F.coalesce(F.concat(F.lit("="), b["alias"]), F.lit("")))), ",")
    return X.edges_of(_extracted(spark, d), "imports").select("repo_id", "id", "source_id", "target_ref", shown.alias("bindings"), a["is_relative"].alias("is_relative"), a["level"].alias("level"))


@query("x11_merge_bindings", f"SELECT repo_id, path, target_ref AS module, {_BINDINGS} AS bindings FROM {EDGES} WHERE type = 'imports'")
def x11(spark: SparkSession, d: str) -> DataFrame:
    """Import statements split from the text natively, merged natively."""
    rows = frame(spark, d, fx.SOURCES).select("repo_id", "path", F.posexplode(F.split("source", "\n")).alias("seq", "line"))
    plain_, frm = F.regexp_extract("line", r"^import (\S+)$", 1), r"^from (\S+) import (\S+)(?: as (\S+))?$"
    alias = F.when(F.regexp_extract("line", frm, 3) != "", F.regexp_extract("line", frm, 3))
    module = F.when(plain_ != "", plain_).otherwise(F.regexp_extract("line", frm, 1))
    name = F.when(plain_ != "", plain_).otherwise(F.regexp_extract("line", frm, 2))
    imports = rows.select("repo_id", "path", module.alias("module"), "seq", F.array(F.struct(name.alias("name"), alias.alias("alias"))).alias("bindings")).filter("module <> ''")
    shown = F.array_join(F.transform("bindings", lambda b: F.concat(b["name"], F.coalesce(F.concat(F.lit("="), b["alias"]), F.lit("")))), ",")
    return X.merge_bindings(imports).select("repo_id", "path", "module", shown.alias("bindings"))


@query("x12_project_imports", f"SELECT repo_id, id, type FROM {EDGES} WHERE target_ref <> 'json' OR type <> 'imports'")
def x12(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    modules = nodes.filter("type = 'module'").select("repo_id", F.col("qualified_name").alias("module"))
    return X.filter_project_imports(edges, modules).select("repo_id", "id", "type")


_BAD_NODES = f"""SELECT repo_id, concat(' ', id) AS id, CASE WHEN node_seq % 7 = 1 THEN '  ' ELSE name END AS name, language, path, CASE WHEN node_seq % 7 = 2 THEN NULL ELSE qualified_name END AS qualified_name,
CASE WHEN node_seq % 7 = 3 THEN 0 ELSE start_line + 1 END AS start_line, CASE WHEN node_seq % 7 = 4 THEN 1 ELSE end_line + 1 END AS end_line FROM ({fx.DOC_NODES}) d"""


@query(
    "x13_validate_nodes",
    f"""SELECT repo_id, trim(id) AS id, CASE WHEN trim(name) = '' THEN 'blank name' WHEN qualified_name IS NULL THEN 'no qualified name' WHEN start_line < 1 THEN 'start line below 1' WHEN end_line < 1 THEN 'end line below 1'
    WHEN end_line < start_line THEN 'end before start' ELSE '' END AS reason FROM ({_BAD_NODES})""",
)
def x13(spark: SparkSession, d: str) -> DataFrame:
    good, bad = X.validate_nodes(frame(spark, d, _BAD_NODES))
    return good.withColumn("reason", F.lit("")).unionByName(bad).select("repo_id", "id", "reason")


_BAD_EDGES = f"""SELECT repo_id, id, CASE WHEN source_id LIKE '%3' THEN concat(source_id, 'x') WHEN source_id LIKE '%4' THEN ' ' ELSE source_id END AS source_id, CASE WHEN target_id LIKE '%5' THEN '' WHEN target_id LIKE '%6' THEN 'p:none' ELSE target_id END AS target_id,
CASE WHEN source_id LIKE '%7' THEN NULL ELSE target_ref END AS target_ref, type FROM ({fx.GRAPH_EDGES}) e"""


@query(
    "x14_validate_edges",
    f"""SELECT e.repo_id, e.id, CASE WHEN trim(source_id) = '' THEN 'blank source' WHEN target_id = '' THEN 'blank target' WHEN target_id IS NULL AND coalesce(target_ref, '') = '' THEN 'no target'
    WHEN s.id IS NULL THEN 'unknown source' WHEN target_id IS NOT NULL AND t.id IS NULL THEN 'unknown target' ELSE '' END AS reason
    FROM ({_BAD_EDGES}) e LEFT JOIN {GN} s ON e.source_id = s.id LEFT JOIN {GN} t ON e.target_id = t.id""",
)
def x14(spark: SparkSession, d: str) -> DataFrame:
    judged = X.judge_edges(frame(spark, d, _BAD_EDGES), frame(spark, d, fx.GRAPH_NODES))
    return judged.select("repo_id", "id", F.coalesce("reason", F.lit("")).alias("reason"))


# ---- resolution ----


@query("r0_lookup_tables", f"SELECT repo_id, name, min_by(id, path) AS id FROM {NODES} WHERE type = 'class' GROUP BY repo_id, name UNION ALL SELECT repo_id, qualified_name, id FROM {NODES} UNION ALL SELECT repo_id, path, id FROM {NODES} WHERE type = 'module'")
def r0(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _graph(spark, d)
    t = R.lookup_tables(nodes)
    return t["by_name"].unionByName(t["by_qname"].select("repo_id", F.col("qualified_name").alias("name"), "id")).unionByName(t["module_by_path"].select("repo_id", F.col("path").alias("name"), "id"))


@query("r1_import_map", f"SELECT repo_id, source_id AS module_id, target_ref AS module_ref, unnest(CASE WHEN target_ref = 'json' THEN ['json'] ELSE [concat('Base', substring(target_ref, 6)), 'h', '*'] END) AS name FROM {EDGES} WHERE type = 'imports'")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return R.import_map(_graph(spark, d)[1]).select("repo_id", "module_id", "module_ref", "name")


for _n, _kind in (("r2_resolve_imports", "imports"), ("r3_resolve_inherits", "inherits"), ("r4_resolve_calls", "calls")):

    @query(_n, f"SELECT repo_id, id, source_id, target_id FROM {EDGES} WHERE type = '{_kind}' AND target_id IS NOT NULL")
    def r234(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        nodes, edges = _graph(spark, d)
        tables, entries = R.lookup_tables(nodes), R.import_map(edges)
        found = {"imports": lambda: R.resolve_imports(edges, tables), "inherits": lambda: R.resolve_inherits(edges, tables, entries), "calls": lambda: R.resolve_calls(edges, tables, entries)}[kind]()
        return found.select("repo_id", "edge.id", "edge.source_id", F.col("found").alias("target_id"))


@query("r5_resolve_edges", f"SELECT repo_id, id, source_id, target_id, target_ref, type, path FROM {EDGES}")
def r5(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return R.resolve_edges(edges, nodes).select("repo_id", "id", "source_id", "target_id", "target_ref", "type", "path")


@query("r6_resolution_stats", f"SELECT repo_id, type, count(target_id) AS resolved, count(*) - count(target_id) AS unresolved FROM {EDGES} WHERE type <> 'defines' GROUP BY ROLLUP (repo_id, type)")
def r6(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return R.resolution_stats(edges, R.resolve_edges(edges, nodes))


# ---- storage ----

_NEW = f"SELECT repo_id, id, concat('new ', raw_source) AS raw_source, 0 AS turn FROM ({fx.DOC_NODES}) a UNION ALL SELECT repo_id, id, concat('again ', raw_source), 1 FROM ({fx.DOC_NODES}) b WHERE node_seq % 5 = 0"
_OLD = f"SELECT repo_id, id, raw_source FROM ({fx.DOC_NODES}) o WHERE node_seq % 2 = 0"


@query("s3_insert_if_absent", f"SELECT repo_id, id, concat('new ', raw_source) AS raw_source, 0 AS turn FROM {DOCS} WHERE node_seq % 2 = 1")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return store.insert_if_absent(frame(spark, d, _OLD), frame(spark, d, _NEW), ["repo_id", "id"], ["turn"])


@query("s3_commit_by_repo", f"SELECT repo_id, id, CASE WHEN node_seq % 2 = 1 THEN concat('new ', raw_source) ELSE raw_source END AS raw_source, CASE WHEN node_seq % 2 = 1 THEN 0 ELSE -1 END AS turn FROM {DOCS}")
def s3_commit(spark: SparkSession, d: str) -> DataFrame:
    """Old rows are committed, then new ones of all keys twice: a run that is repeated changes nothing."""
    path, schema = f"{shared_folder(spark)}/cairn-store-{uuid.uuid4().hex}", "repo_id string, id string, raw_source string, turn int"
    store.commit_by_repo(frame(spark, d, _OLD).select("repo_id", "id", "raw_source", F.lit(-1).alias("turn")), path)
    for _ in range(2):
        new = frame(spark, d, _NEW).select("repo_id", "id", "raw_source", F.col("turn").cast("int").alias("turn"))
        store.change_by_repo(path, schema, new, lambda old, rows: old.unionByName(store.insert_if_absent(old, rows, ["repo_id", "id"], ["turn"])))
    return store.table_by_repo(spark, path, schema)


@query("s4_upsert_repositories", "SELECT n_name AS id, CASE WHEN n_regionkey < 3 THEN upper(n_comment_) ELSE n_name END AS name, CASE WHEN n_regionkey < 3 THEN 'new' ELSE 'old' END AS path FROM (SELECT *, lower(n_name) AS n_comment_ FROM nation)")
def s4(spark: SparkSession, d: str) -> DataFrame:
    nation = fx.tables(spark, d, ["nation"])["nation"]
    old = nation.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("old").alias("path"), F.lit("2020-01-01").cast("timestamp").alias("indexed_at"))
    new = nation.filter("n_regionkey < 3").select(F.col("n_name").alias("id"), F.upper(F.lower("n_name")).alias("name"), F.lit("new").alias("path"))
    return store.upsert_repositories(old, new).select("id", "name", "path")


@query("s4_replace_languages", "SELECT n_name AS repo_id, unnest(CASE WHEN n_regionkey < 2 THEN ['python', 'sql'] WHEN n_regionkey = 2 THEN [] ELSE ['go'] END) AS language FROM nation")
def s4b(spark: SparkSession, d: str) -> DataFrame:
    nation = fx.tables(spark, d, ["nation"])["nation"]
    old = nation.select(F.col("n_name").alias("repo_id"), F.lit("go").alias("language"))
    langs = F.when(F.col("n_regionkey") < 2, F.array(F.lit("python"), F.lit("sql"), F.lit("python"))).otherwise(F.array().cast("array<string>"))
    return store.replace_languages(old, nation.filter("n_regionkey < 3").select(F.col("n_name").alias("id"), langs.alias("languages")))


@query("s5_upsert_embeddings", "SELECT cast(vec_id AS string) AS node_id, cast(0 AS int) AS chunk_index, CASE WHEN vec_id % 3 = 0 THEN 'later' ELSE 'old' END AS chunk_text FROM embeddings")
def s5(spark: SparkSession, d: str) -> DataFrame:
    e = fx.tables(spark, d, ["embeddings"])["embeddings"].select(F.col("vec_id").cast("string").alias("node_id"), "embedding", "vec_id")
    old = e.select("node_id", F.lit(0).alias("chunk_index"), F.lit("old").alias("chunk_text"), "embedding", F.lit(0).alias("turn"))
    new = e.filter("vec_id % 3 = 0").select("node_id", F.explode(F.array(F.struct(F.lit("first").alias("chunk_text"), F.lit(1).alias("turn")), F.struct(F.lit("later").alias("chunk_text"), F.lit(2).alias("turn")))).alias("x"), "embedding").select("node_id", "x.*", "embedding")
    return store.upsert_embeddings(old, new, ["turn"]).select("node_id", "chunk_index", "chunk_text")


@query("s6_update_summaries", f"SELECT repo_id, id, CASE WHEN node_seq % 4 = 1 THEN concat('New ', name) ELSE summary END AS summary FROM {DOCS}")
def s6(spark: SparkSession, d: str) -> DataFrame:
    nodes = frame(spark, d, fx.DOC_NODES)
    fresh = nodes.filter("node_seq % 4 = 1").select("repo_id", "id", F.concat(F.lit("New "), "name").alias("summary"))
    return store.update_summaries(nodes, fresh).select("repo_id", "id", "summary")


@query("s7_nodes_by_repo", f"SELECT repo_id, path, start_line, id, summary FROM {DOCS}")
def s7(spark: SparkSession, d: str) -> DataFrame:
    return store.nodes_by_repo(frame(spark, d, fx.DOC_NODES)).select("repo_id", "path", "start_line", "id", "summary")


@query("s8_nodes_by_ids", f"SELECT s.query_id, n.repo_id, n.id, n.name FROM ({fx.GRAPH_SEEDS}) s JOIN {GN} n ON s.id = n.id")
def s8(spark: SparkSession, d: str) -> DataFrame:
    return store.nodes_by_ids(frame(spark, d, fx.GRAPH_NODES), frame(spark, d, fx.GRAPH_SEEDS)).select("query_id", "repo_id", "id", "name")


@query("s9_incident_edges", f"SELECT DISTINCT e.repo_id, e.id, e.source_id, e.target_id, e.type FROM {GE} e JOIN ({fx.GRAPH_SEEDS}) s ON e.source_id = s.id OR e.target_id = s.id")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return store.incident_edges(frame(spark, d, fx.GRAPH_EDGES), frame(spark, d, fx.GRAPH_SEEDS)).select("repo_id", "id", "source_id", "target_id", "type")


@query("d1_type_counts", f"SELECT repo_id, type, count(*) AS n FROM {NODES} GROUP BY repo_id, type")
def d1(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import type_counts

    return type_counts(X.nodes_of(_extracted(spark, d)))


@query("d2_resolved_edges", f"SELECT repo_id, substring(source_id, 1, 8) AS source, target_ref, type FROM {EDGES} WHERE target_id IS NOT NULL")
def d2(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import resolved_edge_report

    nodes, edges = _graph(spark, d)
    return resolved_edge_report(R.resolve_edges(edges, nodes))

"""Inputs derived from the base tables by one SQL text each, run on both engines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

SPACES = "[ \\t-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"

#: One node for each document.
DOC_NODES = """
SELECT concat('r', cast(doc_id % 4 AS string)) AS repo_id, cast(doc_id AS string) AS id, concat('d', cast(doc_id AS string)) AS name,
       CASE doc_id % 10 WHEN 0 THEN 'module' WHEN 1 THEN 'class' ELSE 'function' END AS type, 'python' AS language,
       concat(source, '/', lang, '.py') AS path, concat(source, '.d', cast(doc_id AS string)) AS qualified_name,
       cast(doc_id AS int) AS start_line, cast(doc_id AS int) AS end_line, text AS raw_source,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('About ', lang) END AS summary, cast(doc_id AS int) AS node_seq
FROM {documents}
"""
#: Every benchmark item asks; two more ask for nothing and for a word that isn't there.
TEXT_QUERIES = """
SELECT item_id AS query_id, text FROM {benchmark}
UNION ALL SELECT max(item_id) + 1, '' FROM {benchmark}
UNION ALL SELECT max(item_id) + 2, 'notawordanywhere' FROM {benchmark}
"""
VECTORS = "SELECT cast(vec_id AS string) AS node_id, embedding FROM {embeddings}"
VECTOR_QUERIES = "SELECT vec_id AS query_id, embedding FROM {embeddings} WHERE vec_id % 20 = 0"
HYBRID_QUERIES = "SELECT item_id AS query_id, text, embedding FROM {benchmark} JOIN {embeddings} ON item_id = vec_id"

#: A property graph of the order tables.
GRAPH_NODES = """
SELECT 'g' AS repo_id, concat(k, ':', cast(i AS string)) AS id, n AS name, t AS type, 'python' AS language, concat(k, '/', cast(i % 7 AS string), '.py') AS path,
       concat(k, '.', n) AS qualified_name, cast(i % 1000 + 1 AS int) AS start_line, cast(i % 1000 + 1 AS int) AS end_line,
       concat('def ', n, chr(10), '    return ', cast(i AS string), ' ') AS raw_source, CASE WHEN i % 3 = 0 THEN NULL ELSE concat('About ', n) END AS summary, cast(0 AS int) AS node_seq
FROM (SELECT 'r' AS k, cast(r_regionkey AS bigint) AS i, r_name AS n, 'module' AS t FROM {region}
      UNION ALL SELECT 'n', cast(n_nationkey AS bigint), n_name, 'module' FROM {nation}
      UNION ALL SELECT 'c', c_custkey, c_name, 'class' FROM {customer}
      UNION ALL SELECT 's', s_suppkey, s_name, 'class' FROM {supplier}
      UNION ALL SELECT 'o', o_orderkey, concat('order', cast(o_orderkey AS string)), 'function' FROM {orders}
      UNION ALL SELECT 'p', p_partkey, p_name, 'function' FROM {part}) x
"""
GRAPH_EDGES = """
SELECT 'g' AS repo_id, sha1(concat(source_id, ':', coalesce(target_id, ref), ':', type)) AS id, source_id, target_id, ref AS target_ref, type
FROM (SELECT concat('r:', cast(n_regionkey AS string)) AS source_id, concat('n:', cast(n_nationkey AS string)) AS target_id, cast(NULL AS string) AS ref, 'defines' AS type FROM {nation}
      UNION ALL SELECT concat('n:', cast(c_nationkey AS string)), concat('c:', cast(c_custkey AS string)), NULL, 'defines' FROM {customer}
      UNION ALL SELECT concat('n:', cast(s_nationkey AS string)), concat('s:', cast(s_suppkey AS string)), NULL, 'defines' FROM {supplier}
      UNION ALL SELECT concat('c:', cast(o_custkey AS string)), concat('o:', cast(o_orderkey AS string)), NULL, 'calls' FROM {orders}
      UNION ALL SELECT DISTINCT concat('o:', cast(l_orderkey AS string)), concat('p:', cast(l_partkey AS string)), 'part', 'calls' FROM {lineitem}
      UNION ALL SELECT DISTINCT concat('p:', cast(l_partkey AS string)), concat('s:', cast(l_suppkey AS string)), NULL, 'imports' FROM {lineitem}
      UNION ALL SELECT concat('o:', cast(o_orderkey AS string)), NULL, 'ext', 'calls' FROM {orders}) x
"""
#: Every supplier asks with its nation's first customer and itself.
GRAPH_SEEDS = """
SELECT s_suppkey AS query_id, 'g' AS repo_id, concat('s:', cast(s_suppkey AS string)) AS id, 1 AS rank FROM {supplier} WHERE s_suppkey % 20 = 0
UNION ALL SELECT s_suppkey, 'g', concat('c:', cast(c AS string)), 2 FROM {supplier} JOIN (SELECT c_nationkey, min(c_custkey) AS c FROM {customer} GROUP BY c_nationkey) x ON s_nationkey = c_nationkey WHERE s_suppkey % 20 = 0
UNION ALL SELECT s_suppkey, 'g', 'x:unknown', 3 FROM {supplier} WHERE s_suppkey % 20 = 0
"""


def _lines(*lines: str) -> str:
    """A text of these lines as an SQL expression; $n and $k stand for the keys."""
    parts = [", ".join(f"cast({x[1]} AS string)" if x in ("$n", "$k") else "'{}'".format(x.replace("'", "''").replace("{", "{{").replace("}", "}}")) for x in re.split(r"(\$[nk])", line) if x) or "''" for line in lines]
    return "concat_ws(chr(10), " + ", ".join(f"concat({p})" for p in parts) + ", '')"


NATION_FILE = _lines("class Base$n:", "    def run(self):", "        return self.step()", "", "    def step(self):", "        return $n", "", "class Shared:", "    pass", "", "def tool_$n(x):", "    return helper_$n(x)", "", "def helper_$n(x):", "    return x")
SUPPLIER_FILE = _lines(
    "import json", "from pkg.n$n import Base$n", "from pkg.n$n import helper_$n as h", "from pkg.n$n import *", "", "class S$k(Base$n):", "    @staticmethod",
    "    def run(self, x: int = 0, *rest: int, **kw) -> int:", "        self.step()", "        tool_$n()", "        h()", "        return json.dumps(x)", "",
    "    def step(self):", "        local_$k(len(str(1)))", "", "def local_$k(a, *args, b: str = \"x\"):", "    return S$k(a).step()",
)
CUSTOMER_FILE = _lines("class C$k(Shared):", "    pass", "", "def local_$k(a):", "    return C$k(a)")
#: A Python file for each nation, supplier and customer.
SOURCES = f"""
SELECT concat('r', cast(n_regionkey AS string)) AS repo_id, concat('pkg/n', cast(n AS string), '.py') AS path, {NATION_FILE} AS source FROM (SELECT n_nationkey AS n, n_regionkey FROM {{nation}}) a
UNION ALL SELECT concat('r', cast(n_regionkey AS string)), concat('sup/s', cast(k AS string), '.py'), {SUPPLIER_FILE} FROM (SELECT s_suppkey AS k, n_nationkey AS n, n_regionkey FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey) b
UNION ALL SELECT concat('r', cast(n_regionkey AS string)), concat('cust/c', cast(k AS string), '.py'), {CUSTOMER_FILE} FROM (SELECT c_custkey AS k, n_nationkey AS n, n_regionkey FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey) c
"""

#: What the files must give, from the base tables alone. Rows: n or k, file, and a definition's lines.
_FILES = """
SELECT concat('r', cast(n_regionkey AS string)) AS repo_id, 'pkg' AS kind, concat('pkg/n', cast(n_nationkey AS string), '.py') AS path, concat('pkg.n', cast(n_nationkey AS string)) AS module, cast(n_nationkey AS bigint) AS n, cast(NULL AS bigint) AS k FROM {nation}
UNION ALL SELECT concat('r', cast(n_regionkey AS string)), 'sup', concat('sup/s', cast(s_suppkey AS string), '.py'), concat('sup.s', cast(s_suppkey AS string)), cast(n_nationkey AS bigint), s_suppkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT concat('r', cast(n_regionkey AS string)), 'cust', concat('cust/c', cast(c_custkey AS string), '.py'), concat('cust.c', cast(c_custkey AS string)), cast(n_nationkey AS bigint), c_custkey FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""
_DEFINITIONS = [
    ("pkg", "module", "", "", 1, 16), ("pkg", "class", "Base$n", "", 1, 6), ("pkg", "function", "run", "Base$n", 2, 3), ("pkg", "function", "step", "Base$n", 5, 6),
    ("pkg", "class", "Shared", "", 8, 9), ("pkg", "function", "tool_$n", "", 11, 12), ("pkg", "function", "helper_$n", "", 14, 15),
    ("sup", "module", "", "", 1, 19), ("sup", "class", "S$k", "", 6, 15), ("sup", "function", "run", "S$k", 7, 12), ("sup", "function", "step", "S$k", 14, 15), ("sup", "function", "local_$k", "", 17, 18),
    ("cust", "module", "", "", 1, 6), ("cust", "class", "C$k", "", 1, 2), ("cust", "function", "local_$k", "", 4, 5),
]
_REFERENCES = [
    # file, edge type, owner (class, name), reference, where it leads: (module, name) or none
    ("pkg", "calls", "Base$n.run", "self.step", "own:Base$n.step"), ("pkg", "calls", "tool_$n", "helper_$n", "own:helper_$n"),
    ("sup", "imports", "", "json", ""), ("sup", "imports", "", "pkg.n$n", "pkg:"), ("sup", "inherits", "S$k", "Base$n", "pkg:Base$n"),
    ("sup", "calls", "S$k.run", "self.step", "own:S$k.step"), ("sup", "calls", "S$k.run", "tool_$n", "pkg:tool_$n"), ("sup", "calls", "S$k.run", "h", ""), ("sup", "calls", "S$k.run", "json.dumps", ""),
    ("sup", "calls", "S$k.step", "local_$k", "own:local_$k"), ("sup", "calls", "S$k.step", "len", ""), ("sup", "calls", "S$k.step", "str", ""),
    ("sup", "calls", "local_$k", "S$k(a).step", ""), ("sup", "calls", "local_$k", "S$k", "own:S$k"),
    ("cust", "inherits", "C$k", "Shared", "first:"), ("cust", "calls", "local_$k", "C$k", "own:C$k"),
]


def _fill(text: str) -> str:
    return "replace(replace('{}', '$n', cast(n AS string)), '$k', coalesce(cast(k AS string), ''))".format(text)


def _values(rows: list[tuple], names: str) -> str:
    shown = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {shown}) AS v({names}))"


_PUT = lambda c: f"replace(replace({c}, '$n', cast(n AS string)), '$k', coalesce(cast(k AS string), ''))"
_LINE_OF = _values([(f, f"{c}.{n}" if c else n, line) for f, _, n, c, line, _ in _DEFINITIONS], "file, what, line")
#: repo_id, id, name, type, path, qualified_name, start_line, end_line, parent (relative name), n, k, module
EXPECTED_NODES = f"""
SELECT repo_id, sha1(concat(repo_id, ':', path, ':', qualified_name, ':', cast(start_line AS string))) AS id,
       CASE WHEN type = 'module' THEN regexp_replace(module, '^.*\\.', '') ELSE name END AS name, type, path, qualified_name, start_line, end_line, rel, module, kind, n, k
FROM (SELECT f.*, type, {_PUT("name")} AS name, start_line, end_line, {_PUT("rel")} AS rel,
             CASE WHEN rel = '' THEN module ELSE concat(module, '.', {_PUT("rel")}) END AS qualified_name
      FROM ({_FILES}) f JOIN {_values([(f, t, n, f"{c}.{n}" if c else n, a, b) for f, t, n, c, a, b in _DEFINITIONS], "file, type, name, rel, start_line, end_line")} d ON f.kind = d.file) x
"""
#: repo_id, id, source_id, target_id, target_ref, type, path
EXPECTED_EDGES = f"""
SELECT e.repo_id, sha1(concat(CASE WHEN e.type = 'imports' THEN e.path ELSE s.id END, ':', ref, ':CodeEdgeType.', upper(e.type))) AS id, s.id AS source_id, t.id AS target_id, ref AS target_ref, e.type, e.path
FROM (SELECT f.*, d.type, {_PUT("owner")} AS owner, {_PUT("ref")} AS ref,
             CASE WHEN leads = '' THEN NULL WHEN leads LIKE 'own:%' THEN concat(module, '.', {_PUT("substring(leads, 5)")})
                  WHEN leads = 'pkg:' THEN concat('pkg.n', cast(n AS string)) WHEN leads LIKE 'pkg:%' THEN concat('pkg.n', cast(n AS string), '.', {_PUT("substring(leads, 5)")})
                  ELSE concat('pkg.n', cast(first_n AS string), '.Shared') END AS leads
      FROM (SELECT a.*, b.first_n FROM ({_FILES}) a JOIN (SELECT repo_id, regexp_replace(min(path), '[^0-9]', '', 'g') AS first_n FROM ({_FILES}) c WHERE kind = 'pkg' GROUP BY repo_id) b ON a.repo_id = b.repo_id) f
      JOIN {_values(_REFERENCES, "file, type, owner, ref, leads")} d ON f.kind = d.file) e
JOIN ({EXPECTED_NODES}) s ON s.repo_id = e.repo_id AND s.path = e.path AND s.rel = e.owner
LEFT JOIN ({EXPECTED_NODES}) t ON t.repo_id = e.repo_id AND t.qualified_name = e.leads
UNION ALL
SELECT c.repo_id, sha1(concat(p.id, ':', c.id, ':CodeEdgeType.DEFINES')), p.id, c.id, c.qualified_name, 'defines', c.path
FROM ({EXPECTED_NODES}) c JOIN ({EXPECTED_NODES}) p ON p.repo_id = c.repo_id AND p.path = c.path AND c.type <> 'module' AND p.rel = regexp_replace(c.rel, '\\.?[^.]*$', '')
"""

TABLES = "region nation customer supplier part orders lineitem documents embeddings benchmark".split()


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a fixture on Spark."""
    return spark.sql(sql, **tables(spark, sf_dir, [t for t in TABLES if f"{{{t}}}" in sql]))


def plain(sql: str) -> str:
    """A fixture's text for an engine that knows the tables by name."""
    return reduce(lambda s, t: s.replace(f"{{{t}}}", t), TABLES, sql).replace("{{", "{").replace("}}", "}")

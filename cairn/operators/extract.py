"""Files to nodes and edges: one flat-map over files with the standard ``ast`` module, native joins and
filters for the rest."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import EDGE_KEY_NAMES, packed, unpacked
from ..schemas import EXTRACTED
from ..sources.shared import dealt, stored

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _sha1(*parts: object) -> str:
    return hashlib.sha1(":".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()


def dotted(path: str) -> str:
    stem = re.sub(r"\.pyw?$", "", path.replace("\\", "/").strip("/"))
    return ".".join(p for p in stem.split("/") if p)


class _Text:
    """A file's bytes with the places of its lines. A byte order mark isn't parsed but counts in offsets."""

    def __init__(self, source: str):
        self.skipped = 3 if source.startswith("﻿") else 0
        self.parsed = source[1:] if self.skipped else source
        self.raw = self.parsed.encode("utf-8", "surrogatepass")
        self.lines = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", self.raw))]

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.lines[node.lineno - 1] + node.col_offset, self.lines[node.end_lineno - 1] + node.end_col_offset

    def cut(self, start: int, end: int) -> str:
        return self.raw[start:end].decode("utf-8", "replace")

    def of(self, node: ast.AST) -> str:
        return self.cut(*self.span(node))

    def bracketed(self, node: ast.AST) -> str:
        """A node's text with the parentheses right around it."""
        start, end = self.span(node)
        while True:
            before, after = self.raw[:start].rstrip(), self.raw[end:]
            gap = len(after) - len(after.lstrip())
            if before[-1:] != b"(" or after.lstrip()[:1] != b")":
                return self.cut(start, end)
            start, end = len(before) - 1, end + gap + 1

    def start(self, node: ast.AST) -> tuple[int, int]:
        """Byte and line where a definition begins, decorators included."""
        decorators = node.decorator_list
        if not decorators:
            return self.span(node)[0], node.lineno
        at = self.raw.rindex(b"@", 0, self.span(decorators[0])[0])
        return at, self.raw.count(b"\n", 0, at) + 1 if b"\r" not in self.raw else sum(x <= at for x in self.lines)

    def decorator(self, node: ast.AST) -> str:
        start, _ = self.span(node)
        text = self.bracketed(node)
        at = self.raw.rindex(b"@", 0, start)
        opening = self.raw[at + 1 : start].decode("utf-8", "replace")
        return (opening[: len(opening) - len(opening.lstrip(" \t"))] if not opening.strip(" \t(") else "") + text


def _calls(text: _Text, body: list[ast.stmt]) -> list[str]:
    """Callee texts in source order, outer before inner, each once. Nested functions and lambdas are not
    entered, but the decorators of nested functions are."""
    found, todo = [], list(body)
    while todo:
        node = todo.pop()
        if isinstance(node, FUNCTIONS):
            todo += node.decorator_list
            continue
        if isinstance(node, ast.Lambda):
            continue
        if isinstance(node, ast.Call):
            start, end = text.span(node)
            found.append((start, -end, text.bracketed(node.func)))
        todo += ast.iter_child_nodes(node)
    return list(dict.fromkeys(name for _, _, name in sorted(found)))


def _arguments(text: _Text, a: ast.arguments) -> dict[str, str | None]:
    """Parameter names with their annotation's text. An annotated splat is lost."""
    out: dict[str, str | None] = {}
    for arg in [*a.posonlyargs, *a.args]:
        out[arg.arg] = text.of(arg.annotation) if arg.annotation else None
    if a.vararg and not a.vararg.annotation:
        out[a.vararg.arg] = None
    for arg in a.kwonlyargs:
        out[arg.arg] = text.of(arg.annotation) if arg.annotation else None
    if a.kwarg and not a.kwarg.annotation:
        out[a.kwarg.arg] = None
    return out


def _imports(module: str, body: list[ast.stmt]) -> list[dict]:
    """Imports of the module's own statements, merged by module in the order they are first met."""
    merged: dict[str, dict] = {}

    def relative(level: int, suffix: str | None) -> str:
        package = module.split(".")[:-1] if "." in module else []
        package = package[: len(package) - (level - 1)] if level - 1 <= len(package) else []
        return ".".join([*package, *(p for p in (suffix or "").split(".") if p)])

    for node in body:
        found: dict[str, dict] = {}

        def add(name: str, binding: tuple[str, str | None] | None, level: int) -> None:
            if name:
                entry = found.setdefault(name, {"module": name, "bindings": [], "is_relative": level > 0, "level": level})  # noqa: B023
                entry["bindings"] += [] if binding is None else [{"name": binding[0], "alias": binding[1]}]

        if isinstance(node, ast.Import):
            for x in node.names:
                add(x.name, (x.name, x.asname), 0)
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            names, star = [(x.name, x.asname) for x in node.names], node.names[0].name == "*"
            if node.level and not node.module:
                for b in names:
                    add(relative(node.level, None if star else b[0]), b, node.level)
            else:
                target = relative(node.level, node.module) if node.level else node.module
                add(target, None, node.level)
                for b in [] if star and node.level else names:
                    add(target, b, node.level)
        for name, entry in found.items():
            if name not in merged:
                merged[name] = entry
                continue
            known = merged[name]["bindings"]
            for b in entry["bindings"]:
                if b not in known:
                    known.append(b)
    return list(merged.values())


def extract_file(repo: str, path: str, source: str) -> tuple[list[dict], list[dict]]:
    """Nodes (module, then definitions in source order, a class before its methods) and edges (imports,
    then those of the definitions) of one file. Raises what ``ast`` raises."""
    text = _Text(source)
    tree = ast.parse(text.parsed)
    module = dotted(path)
    nodes: list[dict] = []
    edges: list[dict] = []

    def node(kind: str, name: str, qualified: str, line: int, end_line: int, start: int, end: int, **attributes: object) -> str:
        key = _sha1(repo, path, qualified, line)
        raw = text.cut(start, end)
        # offsets on and after the first line lie behind the byte order mark
        shift = text.skipped
        row = {"id": key, "name": name, "type": kind, "language": "python", "path": path, "qualified_name": qualified, "start_line": line, "end_line": end_line}
        row |= {"start_byte": start + shift, "end_byte": end + shift, "raw_source": raw, "summary": None, "attributes": attributes, "node_seq": len(nodes)}
        nodes.append(row)
        return key

    def edge(kind: str, source_id: str, ref: str, target: str | None = None, key: tuple[str, str] | None = None, **attributes: object) -> None:
        first, second = key or (source_id, ref)
        row = {"id": _sha1(first, second, EDGE_KEY_NAMES[kind]), "source_id": source_id, "target_id": target, "target_ref": ref, "type": kind, "attributes": attributes}
        edges.append(row | {"path": path, "edge_seq": len(edges)})

    name = module.rsplit(".", 1)[-1] or re.sub(r"\.[^.]*$", "", path.replace("\\", "/").rsplit("/", 1)[-1])
    top = node("module", name, module, 1, len(text.lines), 0, len(text.raw))
    if text.skipped:
        nodes[0] |= {"start_byte": 0, "raw_source": source}
    for entry in _imports(module, tree.body):
        edge("imports", top, entry["module"], key=(path, entry["module"]), **entry)

    def prefix(parent: str, n: str) -> str:
        return f"{parent}.{n}" if parent else n

    def function(f: ast.FunctionDef | ast.AsyncFunctionDef, parent: str, parent_name: str) -> None:
        start, line = text.start(f)
        qualified = prefix(parent_name, f.name)
        args, returns = _arguments(text, f.args), text.of(f.returns) if f.returns else None
        # how the summary prompt shows them
        meta = f"Args: {args} | Returns: {returns}"
        key = node("function", f.name, qualified, line, f.end_lineno, start, text.span(f)[1], decorators=[text.decorator(d) for d in f.decorator_list], args=args, arg_names=list(args), returns=returns, is_async=isinstance(f, ast.AsyncFunctionDef), meta=meta)
        edge("defines", parent, qualified, key, key=(parent, key))
        for callee in _calls(text, f.body):
            edge("calls", key, callee)

    for item in tree.body:
        if isinstance(item, FUNCTIONS):
            function(item, top, module)
        elif isinstance(item, ast.ClassDef):
            start, line = text.start(item)
            qualified, bases = prefix(module, item.name), [text.bracketed(b) if len(item.bases) + len(item.keywords) > 1 else text.of(b) for b in item.bases]
            meta = f"Inherits from: {bases if bases else 'nothing'}"
            key = node("class", item.name, qualified, line, item.end_lineno, start, text.span(item)[1], decorators=[text.decorator(d) for d in item.decorator_list], bases=bases, meta=meta)
            edge("defines", top, qualified, key, key=(top, key))
            for b in bases:
                edge("inherits", key, b, source_file=path)
            for child in item.body:
                if isinstance(child, FUNCTIONS):
                    function(child, key, qualified)
    return nodes, edges


_NODE_DEFAULTS = dict.fromkeys(("decorators", "args", "arg_names", "returns", "is_async", "bases", "meta"))
_EDGE_DEFAULTS = dict.fromkeys(("module", "bindings", "is_relative", "level", "source_file"))


#: Files whose nodes and edges a task holds as Python objects at a time.
FILES = 256


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for a in range(0, len(whole), FILES):
            batch, rows = whole[a : a + FILES], []
            for repo, path, source in zip(batch.repo_id, batch.path, batch.source):
                try:
                    nodes, edges = extract_file(repo, path, source)
                    for rows_of, defaults in ((nodes, _NODE_DEFAULTS), (edges, _EDGE_DEFAULTS)):
                        for r in rows_of:
                            r["attributes"] = defaults | r["attributes"]
                    rows.append((repo, path, nodes, edges, None))
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    rows.append((repo, path, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["repo_id", "path", "nodes", "edges", "error"])


def extract(sources: DataFrame) -> DataFrame:
    """One row a file: its nodes and edges, or the error of one that can't be parsed. Null sources and paths give
    no row. Files are dealt to all cores first: a file takes far longer to parse than to move, and a table
    of many small files may lie in one partition."""
    rows = sources.select("repo_id", "path", "source").filter("path is not null and source is not null")
    return dealt(rows, "repo_id", "path").mapInPandas(_extract, EXTRACTED)


def nodes_of(extracted: DataFrame, kind: str | None = None) -> DataFrame:
    """The nodes, of one type if asked for."""
    rows = extracted.select("repo_id", F.inline("nodes"))
    return rows.filter(F.col("type") == kind) if kind else rows


def edges_of(extracted: DataFrame, kind: str | None = None) -> DataFrame:
    rows = extracted.select("repo_id", F.inline("edges"))
    return rows.filter(F.col("type") == kind) if kind else rows


def rejects_of(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error is not null").select("repo_id", "path", "error")


def defines_of(nodes: DataFrame) -> DataFrame:
    """(repo_id, source_id, target_id) of module-to-definition and class-to-method edges, by joining children
    to parents on their qualified name within a file."""
    child = nodes.filter("type <> 'module'").withColumn("parent_name", F.regexp_replace("qualified_name", r"\.?[^.]*$", ""))
    parent = nodes.filter("type <> 'function'").select("repo_id", "path", F.col("qualified_name").alias("parent_name"), F.col("id").alias("source_id"), F.col("node_seq").alias("parent_seq"), F.col("type").alias("parent_type"))
    met = child.join(parent, ["repo_id", "path", "parent_name"]).filter((F.col("parent_seq") < F.col("node_seq")) & ((F.col("type") == "function") | (F.col("parent_type") == "module")))
    return met.groupBy("repo_id", "id").agg(F.max_by("source_id", "parent_seq").alias("source_id")).select("repo_id", "source_id", F.col("id").alias("target_id"))


def inherits_of(nodes: DataFrame) -> DataFrame:
    """(repo_id, source_id, target_ref, source_file) of each base of each class."""
    return nodes.filter("type = 'class'").select("repo_id", F.col("id").alias("source_id"), F.explode("attributes.bases").alias("target_ref"), F.col("path").alias("source_file"))


def merge_bindings(imports: DataFrame) -> DataFrame:
    """Import rows (repo_id, path, module, seq, bindings) merged by file and module: the bindings in order,
    each (name, alias) once; the native twin of the merge inside a file."""
    rows = imports.groupBy("repo_id", "path", "module").agg(F.sort_array(F.collect_list(F.struct("seq", "bindings"))).alias("all"))
    return rows.select("repo_id", "path", "module", F.array_distinct(F.flatten(F.transform("all", lambda x: x["bindings"]))).alias("bindings"))


def filter_project_imports(edges: DataFrame, modules: DataFrame | None) -> DataFrame:
    """Import edges whose module is one of ``modules`` (repo_id, module), lies in one, or holds one; without
    a set, or for a repository with an empty one, all stay. Other edges stay. Both sides are exploded
    to their dotted prefixes, so the match is two equi-joins."""
    if modules is None:
        return edges
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda n: F.array_join(F.slice(F.split(c, r"\."), F.lit(1), n), "."))
    own = modules.filter("module <> ''").select("repo_id", F.col("module").alias("target_ref")).distinct()
    above = modules.filter("module <> ''").select("repo_id", F.explode(prefixes(F.col("module"))).alias("target_ref")).distinct()
    refs = edges.filter("type = 'imports'").select("repo_id", "target_ref").distinct()
    inside = refs.select("repo_id", F.col("target_ref").alias("ref"), F.explode(prefixes(F.col("target_ref"))).alias("target_ref")).join(own, ["repo_id", "target_ref"], "left_semi").select("repo_id", F.col("ref").alias("target_ref"))
    kept = inside.unionByName(refs.join(above, ["repo_id", "target_ref"], "left_semi")).distinct()
    empty = refs.select("repo_id").distinct().join(own.select("repo_id").distinct(), "repo_id", "left_anti")
    chosen = edges.filter("type = 'imports'").join(kept, ["repo_id", "target_ref"], "left_semi")
    unset = edges.filter("type = 'imports'").join(empty, "repo_id", "left_semi")
    return edges.filter("type <> 'imports'").unionByName(chosen).unionByName(unset)


def validate_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows with trimmed names, rejects with their reason)."""
    trimmed = nodes
    for c in ("id", "name", "language", "path", "qualified_name"):
        trimmed = trimmed.withColumn(c, F.trim(c))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    reason = (
        F.when(blank("id"), "blank id").when(blank("name"), "blank name").when(F.col("qualified_name").isNull(), "no qualified name")
        .when(F.coalesce(F.col("start_line") < 1, F.lit(True)), "start line below 1").when(F.coalesce(F.col("end_line") < 1, F.lit(True)), "end line below 1")
        .when(F.col("end_line") < F.col("start_line"), "end before start")
    )
    judged = trimmed.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


#: Targets of edges that are told apart by themselves, and those among them that no node has and that go to all edges.
SMALL, MOST_UNKNOWN = 10_000, 1_000_000


def judge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges and why each is rejected (reason; null for a valid one): sources must be nodes, and targets too where
    there are any.

    What a row itself tells comes first; such rows, and open ones, are dealt by their ids, as their ends may be all
    the same. The nodes' keys are what a task holds, so edges are shuffled once an end and never sorted. Where edges
    have over ``SMALL`` targets, these are told apart by themselves first: if up to ``MOST_UNKNOWN`` of them are no
    nodes, these go to the edges, which then are shuffled by their sources alone, without their targets."""
    ids = nodes.select("repo_id", F.col("id").alias("_end"), F.lit(True).alias("_known")).distinct().hint("shuffle_hash")
    targets = edges.filter("target_id is not null").select("repo_id", F.col("target_id").alias("_end")).distinct()
    targets = stored(targets.join(ids, ["repo_id", "_end"], "left"), "targets")
    unknown = targets.filter("_known is null").select("repo_id", F.col("_end").alias("target_id"), F.lit("unknown target").alias("_gone"))
    few = targets.count() > SMALL and unknown.limit(MOST_UNKNOWN + 1).count() <= MOST_UNKNOWN
    blank = lambda c: F.col(c).isNotNull() & (F.trim(c) == "")
    own = (
        F.when(F.coalesce(F.trim("id") == "", F.lit(True)), "blank id").when(F.coalesce(F.trim("source_id") == "", F.lit(True)), "blank source")
        .when(blank("target_id"), "blank target").when(F.col("target_id").isNull() & (F.coalesce(F.col("target_ref"), F.lit("")) == ""), "no target")
    )
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 16)).cast("string")
    gone = F.lit(None).cast("string")
    if few:
        edges, gone = edges.join(F.broadcast(unknown), ["repo_id", "target_id"], "left").select(*edges.columns, "_gone"), F.col("_gone")
    judged = edges.withColumn("reason", own).withColumn("_spread", spread).withColumn("id", packed(F.col("id")))
    for end in ("source",) if few else ("source", "target"):
        asks = F.col("reason").isNull() & F.col(f"{end}_id").isNotNull()
        judged = judged.withColumn("_asks", asks).withColumn("_end", F.when(asks, F.col(f"{end}_id")).otherwise(F.col("_spread"))).join(ids, ["repo_id", "_end"], "left")
        judged = judged.select(*edges.columns, spread.alias("_spread"), F.when(F.col("_asks") & F.col("_known").isNull(), f"unknown {end}").otherwise(F.col("reason")).alias("reason"))
    judged = judged.withColumn("reason", F.coalesce("reason", gone)).drop("_gone")
    return judged.withColumn("id", unpacked(F.col("id"))).drop("_spread")


def validate_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with their reason): see ``judge_edges``."""
    judged = judge_edges(edges, nodes)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")

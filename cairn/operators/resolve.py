"""References to nodes: every lookup is reduced to the first node of a key, all candidates of all edges are
joined to it once, and the first step that finds something wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import walk_key

#: Candidate rows of an edge: the step and place in it that decide, what to look up, and the type it must have.
CANDIDATE = ["repo_id", "edge", "step", "place", "name", "needs"]


def lookup_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """by_qname and by_name (classes) with the first node of each key in walk order, and module_by_path with
    the last. Nodes repeated with an id count once, as the first."""
    order = F.struct(walk_key(F.col("path")).alias("w"), F.col("node_seq").alias("s"))
    rows = nodes.select("repo_id", "id", "name", "type", "path", "qualified_name", order.alias("o"))
    once = rows.groupBy("repo_id", "id").agg(F.min_by(F.struct("name", "type", "path", "qualified_name", "o"), "o").alias("n")).select("repo_id", "id", "n.*")
    first = lambda by: once.groupBy("repo_id", by).agg(F.min_by(F.struct("id", "type"), "o").alias("v"))
    named = once.filter("type = 'class'").groupBy("repo_id", "name").agg(F.min_by("id", "o").alias("id"))
    modules = once.filter("type = 'module'").groupBy("repo_id", "path").agg(F.max_by("id", "o").alias("id"))
    return {"nodes": once, "by_qname": first("qualified_name").select("repo_id", "qualified_name", "v.id", "v.type"), "by_name": named, "module_by_path": modules}


def import_map(edges: DataFrame) -> DataFrame:
    """(repo_id, module_id, name, module_ref, place): entries of each importing module in order; an alias
    stands for the name."""
    rows = edges.filter("type = 'imports'").select("repo_id", F.col("source_id").alias("module_id"), F.col("target_ref").alias("module_ref"), "edge_seq", F.posexplode("attributes.bindings").alias("pos", "b"))
    name = F.coalesce(F.when(F.col("b.alias") != "", F.col("b.alias")), F.col("b.name"))
    return rows.select("repo_id", "module_id", name.alias("name"), "module_ref", (F.col("edge_seq").cast("long") * 1_000_000 + F.col("pos")).alias("place")).filter("name <> ''")


def module_path(ref: Column) -> Column:
    return F.concat(F.replace(ref, F.lit("."), F.lit("/")), F.lit(".py"))


def _open(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter((F.col("type") == kind) & F.col("target_id").isNull() & (F.coalesce(F.col("target_ref"), F.lit("")) != ""))


def _key() -> Column:
    return F.struct("id", "source_id").alias("edge")


def resolve_imports(edges: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(repo_id, edge, found): the module whose path spells the reference. Packages and outside modules have
    none."""
    rows = _open(edges, "imports").select("repo_id", _key(), module_path(F.col("target_ref")).alias("path"))
    return rows.join(tables["module_by_path"].withColumnRenamed("id", "found"), ["repo_id", "path"]).select("repo_id", "edge", "found")


def _homes(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Adds the source node's type, qualified name and module (id and name), where they are known."""
    node = tables["nodes"].select("repo_id", F.col("id").alias("source_id"), F.col("type").alias("source_type"), F.col("path").alias("source_path"), F.col("qualified_name").alias("source_name"))
    module = tables["module_by_path"].select("repo_id", F.col("path").alias("source_path"), F.col("id").alias("module_id"))
    name = tables["nodes"].filter("type = 'module'").select("repo_id", F.col("id").alias("module_id"), F.col("qualified_name").alias("module_name"))
    return rows.join(node, ["repo_id", "source_id"], "left").join(module, ["repo_id", "source_path"], "left").join(name, ["repo_id", "module_id"], "left")


def _first_found(candidates: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One join for all steps of all edges, then the least (step, place)."""
    known = tables["by_qname"].select("repo_id", F.col("qualified_name").alias("name"), F.col("id").alias("found"), F.col("type").alias("is"))
    met = candidates.join(known, ["repo_id", "name"]).filter(F.col("needs").isNull() | (F.col("needs") == F.col("is")))
    return met.groupBy("repo_id", "edge").agg(F.min_by("found", F.struct("step", "place")).alias("found"))


def _named_and_starred(rows: DataFrame, entries: DataFrame, needs: str | None, tables: dict[str, DataFrame]) -> DataFrame:
    """Candidates from import entries: those of the target's name (step 2) and the stars (step 3),
    whose module must be a file."""
    lit = F.lit(needs).cast("string")
    named = rows.filter("target <> '*'").join(entries.select("repo_id", "module_id", F.col("name").alias("target"), "module_ref", "place"), ["repo_id", "module_id", "target"])
    star = rows.join(entries.filter("name = '*'").select("repo_id", "module_id", "module_ref", "place"), ["repo_id", "module_id"])
    path = tables["module_by_path"].select("repo_id", F.col("path").alias("ref_path"))
    star = star.withColumn("ref_path", module_path(F.col("module_ref"))).join(path, ["repo_id", "ref_path"], "left_semi")
    made = [r.select("repo_id", "edge", F.lit(k).alias("step"), "place", F.concat_ws(".", "module_ref", "target").alias("name"), lit.alias("needs")) for k, r in ((2, named), (3, star))]
    return made[0].unionByName(made[1])


def resolve_inherits(edges: DataFrame, tables: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """(repo_id, edge, found): a class of the own module, by a named import, by a starred import of a known
    module, or the first class of that bare name in the repository."""
    rows = _open(edges, "inherits").select("repo_id", "source_id", _key(), F.col("target_ref").alias("target"))
    homes = _homes(rows, tables)
    own = homes.filter("module_id is not null").select("repo_id", "edge", F.lit(1).alias("step"), F.lit(0).cast("long").alias("place"), F.concat_ws(".", "module_name", "target").alias("name"), F.lit("class").alias("needs"))
    met = _first_found(own.unionByName(_named_and_starred(homes, entries, "class", tables)), tables)
    bare = rows.join(tables["by_name"].select("repo_id", F.col("name").alias("target"), F.col("id").alias("bare")), ["repo_id", "target"]).select("repo_id", "edge", "bare")
    both = rows.select("repo_id", "edge").join(met, ["repo_id", "edge"], "left").join(bare, ["repo_id", "edge"], "left")
    return both.select("repo_id", "edge", F.coalesce("found", "bare").alias("found")).filter("found is not null")


def resolve_calls(edges: DataFrame, tables: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """(repo_id, edge, found): self and cls stripped from a method's call mean its own class first; then the
    own module, named imports, starred imports. Any type of node is taken; there is no bare-name step."""
    stripped = F.regexp_replace("target_ref", r"^(self|cls)(\.|$)", "")
    rows = _open(edges, "calls").select("repo_id", "source_id", _key(), stripped.alias("target"), (stripped != F.col("target_ref")).alias("own"))
    homes = _homes(rows.filter("target <> ''"), tables).filter("source_name is not null and module_name <> ''")
    owner = F.regexp_replace("source_name", r"\.[^.]*$", "")
    none = F.lit(None).cast("string")
    place = F.lit(0).cast("long")
    method = F.startswith(owner, F.concat("module_name", F.lit(".")))
    zero = homes.filter(F.col("own") & method).select("repo_id", "edge", F.lit(0).alias("step"), place.alias("place"), F.concat_ws(".", owner, F.col("target")).alias("name"), none.alias("needs"))
    one = homes.select("repo_id", "edge", F.lit(1).alias("step"), place.alias("place"), F.concat_ws(".", "module_name", "target").alias("name"), none.alias("needs"))
    return _first_found(zero.unionByName(one).unionByName(_named_and_starred(homes, entries, None, tables)), tables)


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All edges, with target_id where a reference resolves; resolved edges stay as they are."""
    tables, entries = lookup_tables(nodes), import_map(edges)
    found = resolve_imports(edges, tables).unionByName(resolve_inherits(edges, tables, entries)).unionByName(resolve_calls(edges, tables, entries))
    found = found.select("repo_id", F.col("edge.id").alias("id"), F.col("edge.source_id").alias("source_id"), "found").distinct()
    joined = edges.join(found, ["repo_id", "id", "source_id"], "left")
    return joined.withColumn("target_id", F.coalesce("target_id", "found")).select(*edges.columns)


def resolution_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo_id, type, resolved, unresolved) over the edges that were open before, with totals where repo_id
    or type is null."""
    tried = before.filter(F.col("target_id").isNull() & (F.coalesce(F.col("target_ref"), F.lit("")) != "")).select("repo_id", "id", "source_id")
    rows = after.join(tried, ["repo_id", "id", "source_id"], "left_semi")
    return rows.rollup("repo_id", "type").agg(F.count_if(F.col("target_id").isNotNull()).alias("resolved"), F.count_if(F.col("target_id").isNull()).alias("unresolved"))

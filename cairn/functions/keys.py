"""Identity of nodes and edges, module names and the order of files in a walk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How an edge's type is written inside its key.
EDGE_KEY_NAMES = {"calls": "CodeEdgeType.CALLS", "imports": "CodeEdgeType.IMPORTS", "defines": "CodeEdgeType.DEFINES", "inherits": "CodeEdgeType.INHERITS"}


def module_name(path: Column) -> Column:
    """Dotted module name of a path: backslashes are slashes, one .py or .pyw ending goes, empty parts go."""
    trimmed = F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")
    stem = F.regexp_replace(trimmed, r"\.pyw?$", "")
    return F.array_join(F.filter(F.split(stem, "/"), lambda p: p != ""), ".")


def node_id(repo_id: Column, path: Column, qualified_name: Column, start_line: Column) -> Column:
    return F.sha1(F.concat_ws(":", repo_id, path, qualified_name, start_line.cast("string")).cast("binary"))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    named = F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_KEY_NAMES.items() for x in kv]), kind)
    return F.sha1(F.concat_ws(":", source, target, named).cast("binary"))


def walk_key(path: Column) -> Column:
    """Sorts paths as a walk meets them: the files of a folder by name, then its folders by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), p))


def packed(id: Column) -> Column:
    """A key as bytes: SHA-1 digests in half their letters, any other text as it is, told apart by the first byte."""
    return F.when(id.rlike(r"^[0-9a-f]{40}\z"), F.concat(F.lit(b"h"), F.unhex(id))).otherwise(F.concat(F.lit(b"t"), id.cast("binary")))


def unpacked(key: Column) -> Column:
    """The key that ``packed`` took."""
    rest = F.substring(key, 2, 2**31 - 1)
    return F.when(F.substring(key, 1, 1) == F.lit(b"h"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))

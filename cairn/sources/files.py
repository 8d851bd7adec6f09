"""Source files as a table."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE
from .shared import stored

#: Folder names that are pruned at any depth.
IGNORED = (
    "__pycache__", ".git", ".hg", ".idea", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".tox", ".venv", ".vscode", "build", "dist", "env", "htmlcov",
    "node_modules", "venv",
)
LANGUAGES = {".py": "python", ".pyw": "python"}


#: Names that a task sends at a time, and bytes of contents.
NAMES, CONTENTS = 10_000, 16 << 20


def _listed(ignored: tuple[str, ...]):
    """What lies in each folder: folders that are walked on, and names ending in ``.py``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo_id, root, folder in zip(batch.repo_id, batch.root, batch.path):
                out = []
                try:
                    with os.scandir(os.path.join(root, folder)) as entries:
                        for e in entries:
                            path = f"{folder}/{e.name}" if folder else e.name
                            if e.is_dir():
                                if e.name not in ignored and not e.is_symlink():
                                    out.append((repo_id, root, path, True))
                            elif e.name.endswith(".py"):
                                out.append((repo_id, root, path, False))
                            if len(out) >= NAMES:
                                yield pd.DataFrame(out, columns=LISTED)
                                out = []
                except OSError:  # a folder that is gone or closed has nothing
                    pass
                yield pd.DataFrame(out, columns=LISTED)

    return run


LISTED = ["repo_id", "root", "path", "is_folder"]
_LISTED = "repo_id string, root string, path string, is_folder boolean"


def list_sources(roots: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(repo_id, root, path) of the names ending in ``.py`` under the roots (repo_id, root), hidden and underscore
    names too (Spark's own readers skip those). Folders named in ``ignored`` are not entered, nor are links to
    folders, and folders that can't be read have nothing.

    The folders of a level are a table that tasks list; what they find is the next level's table. No path goes
    through the driver, and a pruned folder costs nothing."""
    tasks = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = roots.select("repo_id", "root", F.lit("").alias("path")).distinct()
    found = []
    while True:
        listed = stored(level.repartition(tasks, "root", "path").mapInPandas(_listed(ignored), _LISTED), "listed")
        found.append(listed.filter("NOT is_folder").select("repo_id", "root", "path"))
        level = listed.filter("is_folder").select("repo_id", "root", "path")
        if level.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, size = [], 0
        for repo_id, root, path in zip(batch.repo_id, batch.root, batch.path):
            with open(os.path.join(root, path), "rb") as f:
                rows.append((repo_id, path, f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")))
            size += len(rows[-1][2])
            if size >= CONTENTS:
                yield pd.DataFrame(rows, columns=["repo_id", "path", "source"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["repo_id", "path", "source"])


def read_repositories(roots: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(repo_id, path, source) of many repositories (repo_id, root) on a mount that executors share. Bytes that
    aren't UTF-8 become U+FFFD; line ends become newlines. An empty folder gives no rows."""
    tasks = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = list_sources(roots.select("repo_id", "root"), ignored)
    return paths.repartition(tasks, "root", "path").mapInPandas(_read, "repo_id string, path string, source string")


def read_sources(spark: SparkSession, root: str, repo_id: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """One repository."""
    return read_repositories(spark.createDataFrame([(repo_id, root)], "repo_id string, root string"), ignored)


def select_parseable(files: DataFrame, languages: dict[str, str] | None = None) -> DataFrame:
    """Files of a known language (by lower-cased ending) that hold more than white space, with it."""
    languages = LANGUAGES if languages is None else languages
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in languages.items() for x in kv]), F.when(suffix != "", suffix))
    return files.withColumn("language", known).filter(F.col("language").isNotNull() & (F.regexp_replace("source", SPACE + "+", "") != ""))

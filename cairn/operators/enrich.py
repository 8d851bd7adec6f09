"""Summaries and embeddings: batches, prompts, model calls by user functions, and their results."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import walk_key
from ..functions.text import EMBED_CHARS, document, estimate_tokens
from ..sources.shared import stored
from .numbering import numbered

#: Nodes and estimated tokens of a summary batch, texts of an embedding call, tries of one text.
MAX_NODES, MAX_TOKENS, OVERHEAD = 20, 50_000, 311
EMBED_BATCH, TRIES = 8, 3
#: Rows that a user function's task holds answers of at a time.
HELD = 256
#: Rows of a repository that a task packs at a time.
STRETCH = 4096
INSTRUCTION = "Summarise each node below in one sentence. Answer with a JSON array of objects with the keys id and summary.\n\n"


def eligible_nodes(nodes: DataFrame, for_summary: bool = False) -> DataFrame:
    """Nodes to index: no modules, with a source; to summarise, functions and classes with a source that
    isn't empty."""
    rows = nodes.filter("type <> 'module' and raw_source is not null")
    return rows.filter("type in ('function', 'class') and raw_source <> ''") if for_summary else rows


def embedding_documents(nodes: DataFrame, max_chars: int = EMBED_CHARS) -> DataFrame:
    rows = eligible_nodes(nodes)
    return rows.select("repo_id", F.col("id").alias("node_id"), F.lit(0).alias("chunk_index"), document(F.col("qualified_name"), F.col("summary"), F.col("raw_source"), max_chars).alias("chunk_text"))


def node_block(index, meta):
    """A node's numbered block, of fixed labels that must match (fixed values). The labels and the first source line stand eight spaces in, later source
    lines as they are."""
    pad = "\n        "
    return F.concat(
        F.lit("### NODE "), index.cast("string"), F.lit(f"{pad}ID: "), "id", F.lit(f"{pad}Name: "), "qualified_name", F.lit(f"{pad}Type: "), "type",
        F.lit(f"{pad}Meta: "), meta, F.lit(f"{pad}Code:{pad}"), "raw_source",
    )


def node_blocks(nodes: DataFrame) -> DataFrame:
    """Eligible nodes with their place in the repository (walk order, from 0), block and its tokens. Only the
    keys and order are numbered, by ranges, so a repository of any size lies in many partitions; texts join the
    numbers afterwards."""
    rows = eligible_nodes(nodes, for_summary=True)
    meta = F.coalesce(F.col("attributes.meta"), F.lit(""))
    narrow = rows.select("repo_id", "id", walk_key(F.col("path")).alias("w"), "start_line", F.col("node_seq").alias("s"))
    places = numbered(narrow, ["repo_id"], [F.col(c) for c in ("w", "s", "start_line", "id")], ["id"])
    both = rows.withColumn("_meta", meta).join(places.withColumn("index", F.col("index").cast("int")), ["repo_id", "id"])
    block = node_block(F.col("index"), F.col("_meta"))
    return both.select("repo_id", "id", "index", block.alias("block"), estimate_tokens(block).alias("tokens"), "qualified_name", "type", F.col("_meta").alias("meta"), "raw_source")


def _jumps(tokens: np.ndarray, max_nodes: int, max_tokens: int, overhead: int) -> np.ndarray:
    """Where the batch after one that begins at each row begins."""
    total = np.concatenate(([0], np.cumsum(tokens.astype(np.int64))))
    at = np.arange(len(tokens))
    fits = np.searchsorted(total, total[:-1] + max_tokens - overhead, "right") - 1
    return np.clip(fits, at + 1, at + max_nodes)


def _exits(max_nodes: int, max_tokens: int, overhead: int, rows: int):
    """For each row where a batch may begin first in a stretch: where the first batch of the next stretch begins
    then, and how many begin here."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("index", ignore_index=True)
        jump = _jumps(part.tokens.to_numpy(), max_nodes, max_tokens, overhead)
        end = min(rows, len(part))
        leaves, count = np.arange(len(part) + max_nodes), np.zeros(len(part) + max_nodes, np.int64)
        for i in range(end - 1, -1, -1):
            leaves[i], count[i] = leaves[jump[i]], count[jump[i]] + 1
        entry = np.arange(min(max_nodes, end))
        first = part.stretch[0]
        return pd.DataFrame({"repo_id": part.repo_id[0], "stretch": first, "entry": entry, "next": first + 1, "exit": leaves[entry] - rows, "n": count[entry]})

    return run


def _numbered(max_nodes: int, max_tokens: int, overhead: int, rows: int):
    """The stretch's rows with their batch, given where its first batch begins and that batch's number. Rows before
    it belong to the batch before."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("index", ignore_index=True)
        jump = _jumps(part.tokens.to_numpy(), max_nodes, max_tokens, overhead)
        at, begins = int(part.entry[0]), np.zeros(len(part), np.int64)
        while at < min(rows, len(part)):
            begins[at] = 1
            at = int(jump[at])
        batch = part.base + np.cumsum(begins) - 1
        return part.assign(batch_no=batch)[: min(rows, len(part))][["repo_id", "id", "index", "tokens", "batch_no"]]

    return run


def summary_batches(blocks: DataFrame, max_nodes: int = MAX_NODES, max_tokens: int = MAX_TOKENS, overhead: int = OVERHEAD, rows: int = STRETCH) -> DataFrame:
    """(repo_id, id, index, tokens, batch_no): greedy packing in node order (indexes from 0 without gaps). A batch
    closes at ``max_nodes`` or when the next node would pass ``max_tokens``; a node over the limit is alone.

    Which batch follows a beginning depends on the next ``max_nodes`` rows alone. So a repository is cut into
    stretches of ``rows`` rows, each with the rows that its last batch may take from the next: a stretch tells,
    for each of the ``max_nodes`` rows where its first batch may begin, where the next stretch's first one does.
    These jumps are doubled to reach every stretch from row 0: after k rounds the first 2^k are known."""
    narrow = stored(blocks.select("repo_id", "id", "index", "tokens"), "packing")
    stretch, over = F.floor(F.col("index") / rows).cast("int"), F.col("index") % rows < max_nodes
    to = F.when((stretch > 0) & over, F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
    dealt = narrow.withColumn("stretch", F.explode(to))
    limits = (max_nodes, max_tokens, overhead, rows)
    jump = stored(dealt.groupBy("repo_id", "stretch").applyInPandas(_exits(*limits), "repo_id string, stretch int, entry int, next int, exit int, n int"), "exits")
    known = stored(jump.groupBy("repo_id").agg(F.lit(0).alias("stretch"), F.lit(0).alias("entry"), F.lit(0).alias("base")), "entries")
    longest = jump.agg(F.coalesce(F.max("stretch"), F.lit(0))).first()[0]
    for _ in range(int(longest).bit_length()):
        met = known.join(jump, ["repo_id", "stretch", "entry"]).select("repo_id", F.col("next").alias("stretch"), F.col("exit").alias("entry"), (F.col("base") + F.col("n")).alias("base"))
        known = stored(known.unionByName(met), "entries")
        far = jump.select("repo_id", F.col("stretch").alias("next"), F.col("entry").alias("exit"), F.col("next").alias("next2"), F.col("exit").alias("exit2"), F.col("n").alias("n2"))
        both = jump.join(far, ["repo_id", "next", "exit"])
        jump = stored(both.select("repo_id", "stretch", "entry", F.col("next2").alias("next"), F.col("exit2").alias("exit"), (F.col("n") + F.col("n2")).alias("n")), "exits")
    placed = dealt.join(known, ["repo_id", "stretch"])
    return placed.groupBy("repo_id", "stretch").applyInPandas(_numbered(*limits), "repo_id string, id string, index int, tokens int, batch_no int")


def summary_prompts(blocks: DataFrame, batches: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """(repo_id, batch_no, prompt, n_nodes, tokens): blocks numbered within their batch."""
    rows = blocks.drop("tokens", "block", "index").join(batches, ["repo_id", "id"])
    start = batches.groupBy("repo_id", "batch_no").agg(F.min("index").alias("first"))
    rows = rows.join(start, ["repo_id", "batch_no"]).withColumn("pos", F.col("index") - F.col("first"))
    rows = rows.withColumn("block", node_block(F.col("pos"), F.col("meta")))
    packed = rows.groupBy("repo_id", "batch_no").agg(F.sort_array(F.collect_list(F.struct("pos", "block"))).alias("b"), F.count(F.lit(1)).alias("n_nodes"), F.sum("tokens").alias("tokens"))
    joined = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return packed.select("repo_id", "batch_no", F.concat(F.lit(instruction), joined).alias("prompt"), "n_nodes", "tokens")


def parse_summaries(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((repo_id, id, summary), malformed rows): a later entry of a response wins, then a later batch; an empty
    response gives nothing."""
    parsed = responses.withColumn("items", F.from_json("response", "array<struct<id:string,summary:string>>"))
    empty = F.trim(F.coalesce("response", F.lit(""))) == ""
    rejects = parsed.filter(~empty & F.col("items").isNull()).drop("items")
    rows = parsed.filter(~empty).select("repo_id", "batch_no", F.posexplode("items").alias("pos", "x")).filter("x.id is not null and x.summary is not null")
    return rows.groupBy("repo_id", F.col("x.id").alias("id")).agg(F.max_by("x.summary", F.struct("batch_no", "pos")).alias("summary")), rejects


def _slices(batches: Iterator[pd.DataFrame], rows: int = HELD) -> Iterator[pd.DataFrame]:
    """The batches, at most ``rows`` rows at a time, so that answers and copies of few rows are held at once."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch[a : a + rows].reset_index(drop=True)


def _answered(fn: Callable[[list[str]], list[str]], column: str, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches with the answers to ``HELD`` rows at a time: a batch of long prompts is never whole in Python's strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, HELD):
                part = batch.slice(a, HELD)
                answers = fn(part.column(column).to_pylist())
                if len(answers) != part.num_rows:
                    raise ValueError(f"{len(answers)} answers to {part.num_rows} prompts")
                made = pa.array([(x or "").strip() for x in answers], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])

    return run


def call_model(prompts: DataFrame, fn: Callable[[list[str]], list[str]], column: str = "prompt", out: str = "response") -> DataFrame:
    """Adds the user function's answer to each prompt, stripped; none gives an empty one."""
    schema = prompts.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return prompts.mapInArrow(_answered(fn, column, out), f"{schema},{out}:string")


def embed_texts(texts: list[str], fn: Callable[[list[str]], list[list[float]]], wait: float = 5.0) -> list[list[float]]:
    """Vectors of a few texts. A failing call is halved, a single text tried again with growing waits; a wrong
    number of vectors is an error."""
    for attempt in range(TRIES):
        try:
            vectors = fn(texts)
            break
        except (ConnectionError, TimeoutError):
            if len(texts) > 1:
                half = len(texts) // 2
                return embed_texts(texts[:half], fn, wait) + embed_texts(texts[half:], fn, wait)
            if attempt == TRIES - 1:
                raise
            time.sleep(wait * (attempt + 1))
    if len(vectors) != len(texts):
        raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    return vectors


def embed(documents: DataFrame, fn: Callable[[list[str]], list[list[float]]], batch_size: int = EMBED_BATCH, wait: float = 5.0) -> DataFrame:
    """Adds ``embedding`` to (…, chunk_text); a text whose tries all fail gets none."""
    schema = documents.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, batch_size * max(1, HELD // batch_size)):
            out: list[list[float] | None] = []
            for a in range(0, len(batch), batch_size):
                texts = list(batch.chunk_text[a : a + batch_size])
                try:
                    out += embed_texts(texts, fn, wait)
                except (ConnectionError, TimeoutError):
                    out += [None] * len(texts)
            yield batch.assign(embedding=out)

    return documents.mapInPandas(run, f"{schema},embedding:array<double>")


def hashing_embedder(size: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests: hashed token counts."""

    def fn(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts):
            for t in text.split():
                row[hashlib.sha1(t.encode()).digest()[0] % size] += 1
        return out.tolist()

    return fn


def index_stats(nodes: DataFrame, summaries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(repo_id, nodes_processed, summaries_generated, embeddings_stored)."""
    rows = eligible_nodes(nodes).select("repo_id", "id")
    s = summaries.select("repo_id", "id", F.lit(1).alias("s")).distinct()
    e = embeddings.filter("embedding is not null").select("repo_id", F.col("node_id").alias("id"), F.lit(1).alias("e")).distinct()
    both = rows.join(s, ["repo_id", "id"], "left").join(e, ["repo_id", "id"], "left")
    return both.groupBy("repo_id").agg(F.count(F.lit(1)).alias("nodes_processed"), F.count("s").alias("summaries_generated"), F.count("e").alias("embeddings_stored"))

"""External counting of pairs over all documents: compressed runs by radix, merged by a heap.

A run holds what one chunk of documents has of one radix of pair keys, sorted by key: each distinct pair, in how
many of the chunk's documents it is, and those documents with their links. Runs are rows of a written table.
Only keys and counts travel to the merge; links travel once, to their radix, and what goes back to a document
are two sums a radix."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import lean, stored

RUN = "chunk long, docs int, radix int, pairs binary, n binary, doc binary, m binary"
#: Runs that one task merges at a time, and pairs of a merged block.
FAN, BLOCK = 128, 1 << 13
SIDE = 32


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=0))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.int64))


def runs_of(keys: np.ndarray, doc: np.ndarray, m: np.ndarray, chunk: int, docs: int, radixes: int) -> Iterator[tuple]:
    """Rows of RUN of a chunk: one radix after another, by the key's upper side, so that all pairs of an upper id
    meet in one. ``keys`` and ``doc`` are sorted by (key, doc) and distinct."""
    radix = (keys >> SIDE) % radixes
    order = np.argsort(radix, kind="stable")
    keys, doc, m, radix = keys[order], doc[order].astype(np.int32), m[order].astype(np.int32), radix[order]
    edges = np.append(np.flatnonzero(np.diff(radix, prepend=-1)), len(radix))
    for a, b in zip(edges, edges[1:]):
        at = np.flatnonzero(np.diff(keys[a:b], prepend=-1))
        yield chunk, docs, int(radix[a]), packed_keys(keys[a:b][at]), packed(np.diff(np.append(at, b - a)).astype(np.int32)), packed(doc[a:b]), packed(m[a:b])


class _Merger:
    """Sums the counts of equal keys over blocks that come in the order of their first keys. A heap holds the
    blocks that are open; what lies under the next block's first key is complete."""

    def __init__(self):
        self.heap: list = []
        self.seq = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done = self.upto(int(keys[0]))
        self.seq += 1
        heapq.heappush(self.heap, (int(keys[0]), self.seq, keys, n))
        return done

    def upto(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        while self.heap and self.heap[0][0] < bound:
            _, seq, keys, n = heapq.heappop(self.heap)
            cut = int(np.searchsorted(keys, bound))
            parts.append((keys[:cut], n[:cut]))
            if cut < len(keys):
                heapq.heappush(self.heap, (int(keys[cut]), seq, keys[cut:], n[cut:]))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        at = np.flatnonzero(np.diff(keys[order], prepend=-1))
        return keys[order][at], np.add.reduceat(n[order], at)


def _merge(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows (radix, run, first, pairs, n) in the order of radix, run and first as blocks of summed counts; in the
    last merge with a mark of the pairs whose count is the highest of their upper id."""
    state: dict = {"of": None, "held": [], "size": 0}

    def blocks(end: bool) -> Iterator[pa.RecordBatch]:
        if not state["held"]:
            return
        keys, n = (np.concatenate(x) for x in zip(*state["held"]))
        upto = len(keys) if end else int(np.searchsorted(keys, (keys[-1] >> SIDE) << SIDE))
        state["held"], state["size"] = [(keys[upto:], n[upto:])], len(keys) - upto
        keys, n = keys[:upto], n[:upto]
        if not upto:
            return
        side = np.flatnonzero(np.diff(keys >> SIDE, prepend=-1))
        top = n == np.repeat(np.maximum.reduceat(n, side), np.diff(np.append(side, upto)))
        for a in range(0, upto, BLOCK):
            s = slice(a, a + BLOCK)
            row = [*state["of"], int(keys[a]), packed_keys(keys[s]), packed(n[s]), packed(top[s]) if last else None]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, KINDS)], NAMES)

    def taken(done: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(done[0]):
            state["held"].append(done)
            state["size"] += len(done[0])
            if state["size"] >= 4 * BLOCK:
                yield from blocks(False)

    merger = _Merger()
    for batch in batches:
        for radix, run, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("radix", "run", "pairs", "n"))):
            if (radix, run) != state["of"]:
                if state["of"] is not None:
                    yield from taken(merger.upto(1 << 62))
                    yield from blocks(True)
                state |= {"of": (radix, run), "held": [], "size": 0}
            yield from taken(merger.add(unpacked_keys(pairs), unpacked(n, np.int64)))
    if state["of"] is not None:
        yield from taken(merger.upto(1 << 62))
        yield from blocks(True)


NAMES = ["radix", "run", "first", "pairs", "n", "top"]
KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
BLOCKS = "radix int, run long, first long, pairs binary, n binary, top binary"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of chunks as blocks, with the first key that blocks are sorted by."""
    for batch in batches:
        rows = []
        for chunk, radix, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "radix", "pairs", "n"))):
            keys, counts = unpacked_keys(pairs), unpacked(n, np.int32).astype(np.int64)
            for a in range(0, len(keys), BLOCK):
                rows.append((radix, chunk, int(keys[a]), packed_keys(keys[a : a + BLOCK]), packed(counts[a : a + BLOCK]), None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], NAMES)


def pair_counts(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """(radix, run, first, pairs, n, top): in how many documents each pair of all ``runs`` is, as sorted blocks.

    Runs are merged ``fan`` at a time, in as many rounds as their number needs, so a task holds ``fan`` blocks
    whatever the corpus. An upper id in any share of the documents has a row a pair here, not a row a document."""
    rows = stored(runs.select("chunk", "radix", "pairs", "n").mapInArrow(lean(_opened), BLOCKS), "blocks")
    left = rows.select("run").distinct().count()
    while True:
        last = left <= fan
        groups = 1 if last else -(-left // fan)
        rows = rows.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(groups)))
        rows = rows.repartition("radix", "run").sortWithinPartitions("radix", "run", "first")
        rows = stored(rows.mapInArrow(lean(lambda batches, last=last: _merge(batches, last)), BLOCKS), "merged")
        if last:
            return rows
        left = groups


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a radix, then its runs: what the run's links add to each document of its chunk."""
    at, held, table = None, [], None
    for batch in batches:
        for radix, salt, chunk, docs, pairs, n, top, doc, m in zip(*(batch.column(c).to_pylist() for c in ("radix", "salt", "chunk", "docs", "pairs", "n", "top", "doc", "m"))):
            if (radix, salt) != at:
                at, held, table = (radix, salt), [], None
            keys = unpacked_keys(pairs)
            if chunk is None:
                held.append((keys, unpacked(n, np.int64), unpacked(top, bool)))
                continue
            if table is None:
                table, held = [np.concatenate(x) for x in zip(*held)], []
            place = np.repeat(np.searchsorted(table[0], keys), unpacked(n, np.int32))
            doc, m = unpacked(doc, np.int32), unpacked(m, np.int32).astype(np.int64)
            out = np.zeros((2, docs), np.int64)
            np.add.at(out[0], doc, m * table[2][place])
            np.add.at(out[1], doc, m * table[1][place])
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([packed(out)], pa.binary())], ["chunk", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, total = None, None

    def rows() -> pa.RecordBatch:
        docs = total.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.full(docs, at), pa.int64()), pa.array(np.arange(docs, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["chunk", "at", "n_best", "count_sum"])

    for batch in batches:
        for chunk, sums in zip(*(c.to_pylist() for c in batch.columns)):
            new = unpacked(sums, np.int64).reshape(2, -1)
            if chunk != at:
                if at is not None:
                    yield rows()
                at, total = chunk, new.copy()
            else:
                total += new
    if at is not None:
        yield rows()


def contributions(runs: DataFrame, counts: DataFrame, together: int = 256) -> DataFrame:
    """(chunk, at, n_best, count_sum): for the document at a place of a chunk, its links whose pair's count is
    the highest of the upper id, and the counts of all its links.

    A task reads one radix of the counts, then about ``together`` chunks' runs of it, one after another."""
    salts = max(1, -(-runs.select("chunk").distinct().count() // together))
    none = lambda kind: F.lit(None).cast(kind)
    table = counts.select("radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("first").alias("place"), none("long").alias("chunk"), none("int").alias("docs"), "pairs", "n", "top", none("binary").alias("doc"), none("binary").alias("m"))
    links = runs.select("radix", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"), F.col("chunk").alias("place"), "chunk", "docs", "pairs", "n", none("binary").alias("top"), "doc", "m")
    both = table.unionByName(links).repartition("radix", "salt").sortWithinPartitions("radix", "salt", F.col("chunk").isNotNull(), "place")
    sums = both.mapInArrow(lean(_sums), "chunk long, sums binary")
    return sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lean(_added), "chunk long, at int, n_best long, count_sum long")

"""Bounded Bloom filters over 64-bit hashes, built by Spark tasks and merged by segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import free_name, lean, stored

SEGMENT = 1 << 16
PROBES = 4
#: Hashes that a task holds before it emits their slots.
FLUSH = 1 << 18
#: Segments that a task merges, one after another: so the driver takes a megabyte at a time.
TOGETHER = 128


def filter_bits(rows: int, bits_per_row: int, most_bits: int) -> int:
    """A power of two, at least one segment and at most ``most_bits``: the bound of what is broadcast.
    Beyond the bound only false positives grow; answers stay right."""
    want = max(SEGMENT, rows * bits_per_row)
    return min(1 << (want - 1).bit_length(), most_bits)


def slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)])


def build(hashes: DataFrame, bits: int, least: int) -> Broadcast:
    """Broadcast bit array of the slots that at least ``least`` (1 or 2) rows of the one bigint column
    ``h`` touch. Tasks send slot numbers by segment, so no task or row holds the whole filter but the
    driver's bounded copy."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[np.ndarray]) -> pa.RecordBatch:
            slot, count = np.unique(slots_of(np.concatenate(held), bits).ravel(), return_counts=True)
            segment, starts = np.unique(slot // np.uint64(SEGMENT), return_index=True)
            ends = np.append(starts[1:], len(slot))
            low = (slot % np.uint64(SEGMENT)).astype(np.uint16)
            rows = [(int(s), low[a:b].tobytes(), low[a:b][count[a:b] > 1].tobytes()) for s, a, b in zip(segment, starts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["segment", "seen", "again"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= FLUSH:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count = None, np.zeros(SEGMENT, np.uint8)
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(count >= least, bitorder="little").tobytes()], pa.binary())], ["segment", "packed"])
        for batch in batches:
            for segment, seen, again in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != at:
                    if at is not None:
                        yield pack()
                    at, count = segment, np.zeros(SEGMENT, np.uint8)
                for part in (seen, again):
                    i = np.frombuffer(part, np.uint16)
                    count[i] = np.minimum(count[i] + 1, 2)
        if at is not None:
            yield pack()

    parts = (
        hashes.mapInArrow(lean(scatter), "segment long, seen binary, again binary")
        .repartition(-(-bits // SEGMENT // TOGETHER), "segment")
        .sortWithinPartitions("segment")
        .mapInArrow(lean(merge), "segment long, packed binary")
    )
    packed = bytearray(bits // 8)
    for row in parts.toLocalIterator(prefetchPartitions=True):
        packed[row.segment * (SEGMENT // 8) : (row.segment + 1) * (SEGMENT // 8)] = row.packed
    return hashes.sparkSession.sparkContext.broadcast(bytes(packed))


def might_contain(packed: Broadcast, bits: int, h: Column) -> Column:
    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        table = np.frombuffer(packed.value, np.uint8)
        slot = slots_of(hashes.to_numpy(), bits)
        hit = (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=0))

    return test(h)


def without_rows(rows: DataFrame, gone: DataFrame, most_bits: int = 1 << 30, row: str = "row_") -> DataFrame:
    """The rows whose ``row`` isn't the ``row_`` of a row of ``gone``, without that column. A bounded filter of what
    goes lets all others pass straight through; only rows it may hold shuffle."""
    gone = stored(gone.select(F.col("row_").alias(row)), "gone")
    key, maybe = F.xxhash64(row), free_name("maybe_", rows.columns)
    bits = filter_bits(gone.count(), 16, most_bits)
    marked = rows.withColumn(maybe, might_contain(build(gone.select(key.alias("h")), bits, least=1), bits, key))
    names = [f"`{c}`" for c in rows.columns if c != row]
    near = marked.filter(maybe).join(gone, row, "left_anti")
    return marked.filter(~F.col(maybe)).select(*names).unionByName(near.select(*names))

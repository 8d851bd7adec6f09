"""Suffix-array dedup (operator 12): bytes covered by a string of ``size`` bytes that also begins anywhere else.

Rolling-hash triggers cut texts, so equal windows fall to equal triggers. Windows of one trigger are a stretch of
text; equal stretches are counted, and what is left of stretches around equal triggers meets in shards, where
prefix-free parsing brings their windows into corpus order (see ``prefix_free``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from ._work import lean, read_table, slices, stored, with_rows
from .prefix_free import grams, ragged, repeated_windows

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
GRAM = 8
#: Bytes of text that a task parses at a time, bytes of stretches that a shard orders at a time, and stretches
#: around one trigger beyond which they are told apart by finer stretches instead.
SLICE, SHARD, MOST = 1 << 18, 1 << 18, 2000
#: By what a stretch is split when too many share its trigger.
FINER = 8
KEY, STRETCH = ["c1", "c2"], ["c1", "c2", "x1", "x2"]
PLACE = "file long, at long, lo long, width int"


def triggers(data: bytes, starts: np.ndarray, reach: int) -> np.ndarray:
    """For each start, the place within the next ``reach`` whose eight bytes hash least, the first of equal ones.
    It depends on the bytes of the window alone, so equal windows have it at the same distance."""
    h = grams(data + bytes(GRAM - 1), GRAM)[: len(data)] * _ODD[0]
    h ^= h >> np.uint64(32)
    h *= _ODD[1]
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(len(h), dtype=np.uint64)
    rows = -(-len(h) // reach) + 1
    block = np.full(rows * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    block[: len(h)] = h
    block = block.reshape(rows, reach)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[starts], before[starts + reach - 1])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _digests(parts: list) -> list[pa.Array]:
    two = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)
    return [pa.array(two[:, 0]), pa.array(two[:, 1])]


def _pieces(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[tuple]:
    """(file, at, bytes, where each text lies in them, its first place, how many windows begin in it): slices of
    whole texts, or a part of a longer one with the bytes its windows need."""
    for batch in slices(batches, "text", most):
        row = batch.column("row_")
        place = [row.field(k).to_numpy() for k in (0, 1)]
        texts = batch.column("text").fill_null("")
        texts = pa.concat_arrays([texts]) if texts.offset else texts
        offsets = texts.offsets.to_numpy() if hasattr(texts, "offsets") else np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
        begin, n = offsets[:-1].astype(np.int64), np.maximum(np.diff(offsets).astype(np.int64) - size + 1, 0)
        data = texts.buffers()[2].to_pybytes() if texts.buffers()[2] is not None else b""
        if len(texts) > 1 or (len(n) and n[0] <= most):
            yield *place, data, begin, np.zeros(len(n), np.int64), n
        elif len(texts):
            for a in range(0, int(n[0]), most):
                w = min(most, int(n[0]) - a)
                yield *place, data[begin[0] + a : begin[0] + a + w + size - 1], np.zeros(1, np.int64), np.array([a]), np.array([w])


def _stretches(size: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, at, data, begin, base, n in _pieces(batches, size, SLICE):
            starts = ragged(begin, n)
            if not len(starts):
                continue
            anchor, text = triggers(data, starts, reach), np.repeat(np.arange(len(n)), n)
            first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
            lo, anchor, text = starts[first], anchor[first], text[first]
            width = np.diff(np.append(first, len(starts)))
            core = size - reach + 1
            names = [*_digests([data[a : a + core] for a in anchor.tolist()]), *_digests([data[a:b] for a, b in zip(lo.tolist(), (lo + width + size - 1).tolist())])]
            place = [pa.array(file[text]), pa.array(at[text]), pa.array(lo - begin[text] + base[text]), pa.array(width.astype(np.int32)), pa.array((anchor - lo).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*names, *place], [*STRETCH, "file", "at", "lo", "width", "x"])

    return run


def _cut(size: int):
    """The bytes of chosen stretches of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for text, chosen in zip(batch.column("text"), batch.column("chosen")):
                data, s = memoryview(text.as_buffer()), chosen.values
                lo, width = s.field("lo").to_numpy(), s.field("width").to_numpy()
                parts = [bytes(data[a : a + w + size - 1]) for a, w in zip(lo.tolist(), width.tolist())]
                yield pa.RecordBatch.from_arrays([*(s.field(k) for k in range(len(s.type))), pa.array(parts, pa.binary())], [*(f.name for f in s.type), "bytes"])

    return run


def _shards(size: int):
    """Whole groups of stretches around equal triggers, as many as a shard takes: which windows of the stretches
    that are alone occur in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, last = [], 0, None

        def settle() -> pa.RecordBatch:
            marks = repeated_windows([r[7] for r in held], np.array([r[6] for r in held], np.int64), size)
            out = []
            for (_, _, n, file, at, lo, _, _), mark in zip(held, marks):
                if n == 1 and mark.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], mark, [False])).astype(np.int8)))
                    out += [(file, at, lo + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["file", "at", "lo", "width"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "n", "file", "at", "lo", "width", "bytes"))):
                if row[:2] != last and total >= SHARD:
                    yield settle()
                    held, total = [], 0
                held.append(row)
                total, last = total + len(row[7]), row[:2]
        if held:
            yield settle()

    return run


def _split(size: int, reach: int):
    """Stretches cut by the distance of their windows to the trigger, at multiples of ``reach``; the key of a part
    is what all windows at such distances have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, core, own = [], [], []
            for n, file, at, lo, width, x, data in zip(*(batch.column(c).to_pylist() for c in ("n", "file", "at", "lo", "width", "x", "bytes"))):
                for b in range(max(0, x - width + 1) // reach, x // reach + 1):
                    s, e = max(0, x - (b + 1) * reach + 1), min(width - 1, x - b * reach)
                    own.append(data[s : e + size])
                    core.append(data[x - b * reach : x - (b + 1) * reach + 1 + size] + b.to_bytes(2, "little"))
                    rows.append((n, file, at, lo + s, e - s + 1, x - s))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*_digests(core), *_digests(own), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), pa.array(own, pa.binary())], [*STRETCH, "n", "file", "at", "lo", "width", "x", "bytes"])

    return run


def _maybe(rows: DataFrame, key, wanted: DataFrame, least: int, most_bits: int) -> DataFrame:
    """The rows whose key a bounded filter of ``wanted`` (bigint column h) may hold."""
    bits = bloom.filter_bits(wanted.count(), 16, most_bits)
    return rows.filter(bloom.might_contain(bloom.build(wanted, bits, least), bits, key))


def _classed(rows: DataFrame) -> DataFrame:
    """Distinct stretches with the number of windows' owners (n), one of them, and how many share the trigger."""
    own = [c for c in rows.columns if c not in (*STRETCH, "n")]
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    counts = stored(rows.groupBy(*STRETCH).agg(n.alias("n"), F.min(F.struct(*own)).alias("one")), "stretches")
    cores = counts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).filter("total > 1")
    return stored(counts.join(cores.drop("total"), KEY).select(*STRETCH, "n", "kinds", "one.*"), "classes")


def repeated_starts(rows: DataFrame, size: int, reach: int, most: int, most_bits: int) -> DataFrame:
    """(file, at, lo, width): where windows begin that also begin elsewhere, as stretches of starts."""
    found = stored(rows.mapInArrow(lean(_stretches(size, reach)), f"c1 long, c2 long, x1 long, x2 long, {PLACE}, x int"), "triggers")
    near = _maybe(found, F.col("c1"), found.select(F.col("c1").alias("h")), 2, most_bits)
    classes = _classed(near)
    equal = near.join(classes.filter("n > 1").select(*STRETCH), STRETCH, "left_semi").select("file", "at", "lo", "width")
    marks = [stored(equal, "equal")]

    unlike = classes.filter("kinds > 1")
    chosen = unlike.groupBy(F.struct("file", "at").alias("row_")).agg(F.collect_list(F.struct(*KEY, "kinds", "n", "file", "at", "lo", "width", "x")).alias("chosen"))
    chosen = stored(chosen, "chosen")
    own = _maybe(rows, F.xxhash64("row_"), chosen.select(F.xxhash64("row_").alias("h")), 1, most_bits)
    cut = own.join(chosen, "row_").select("text", "chosen").mapInArrow(lean(_cut(size)), f"c1 long, c2 long, kinds long, n long, {PLACE}, x int, bytes binary")
    cut = stored(cut, "cut")
    while True:
        few = cut.filter(F.col("kinds") <= most).repartition(*KEY).sortWithinPartitions(*KEY)
        marks.append(stored(few.mapInArrow(lean(_shards(size)), PLACE), "shards"))
        hot = cut.filter(F.col("kinds") > most)
        if reach == 1 or hot.isEmpty():
            break
        reach = max(1, reach // FINER)
        parts = stored(hot.mapInArrow(lean(_split(size, reach)), f"c1 long, c2 long, x1 long, x2 long, n long, {PLACE}, x int, bytes binary"), "parts")
        classes = _classed(parts)
        again = classes.filter("n > 1").select(*STRETCH)
        marks.append(stored(parts.filter("n = 1").join(again, STRETCH, "left_semi").select("file", "at", "lo", "width"), "equal"))
        cut = classes.filter("kinds > 1").drop("x1", "x2")
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def _removed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, marks in zip(batch.column("text"), batch.column("marks")):
                data, s = memoryview(text.as_buffer()), marks.values
                lo, width = s.field("lo").to_numpy(), s.field("width").to_numpy()
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate((lo + width + size - 1)[order])
                new = np.append(True, lo[1:] > end[:-1])
                a, b = lo[new], end[np.append(new[1:], True)]
                sha = hashlib.sha256()
                for x, y in zip(np.append(0, b).tolist(), np.append(a, len(data)).tolist()):
                    sha.update(data[x:y])
                out.append((int((b - a).sum()), len(a), sha.hexdigest(), a.tolist(), b.tolist()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row_"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["row_", "n_removed", "n_spans", "sha", "begins", "ends"])

    return run


def remove_repeats(docs: DataFrame, size: int = 400, reach: int = 256, most: int = MOST, most_bits: int = 1 << 30) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans as lists of
    first bytes (begins) and bytes after the last (ends).

    Texts are UTF-8 bytes; every byte goes that lies in a string of ``size`` bytes which also begins at another
    place of any text, the same one included. Null and empty texts have no bytes and the digest of nothing; texts
    shorter than ``size`` lose nothing. Rows repeated with one id are texts of their own, so they lose all that
    they share; null ids are kept. An empty table gives an empty table. Other columns are not carried.

    At most ``reach`` starts, a power of two, share a trigger, which must lie in their windows: ``reach`` + 7 is at
    most ``size``. Stretches whose trigger may occur
    twice are counted; equal ones need no bytes. Of unlike stretches around equal triggers one of each kind goes
    to a shard; where more than ``most`` kinds meet, stretches are told apart by parts an eighth as long, down to
    single windows, so no group is held in one task. Texts move only if a bounded filter holds their row."""
    if reach < 1 or reach & (reach - 1) or reach + GRAM - 1 > size:
        raise ValueError("reach must be a power of two, and reach + 7 at most size")
    rows = with_rows(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    marks = repeated_starts(rows, size, reach, most, most_bits)
    by_row = stored(marks.groupBy(F.struct("file", "at").alias("row_")).agg(F.collect_list(F.struct("lo", "width")).alias("marks")), "marks")
    near = _maybe(rows, F.xxhash64("row_"), by_row.select(F.xxhash64("row_").alias("h")), 1, most_bits)
    cut = near.join(by_row, "row_").select("row_", "text", "marks").mapInArrow(lean(_removed(size)), "row_ struct<file:long,at:long>, n_removed long, n_spans long, sha string, begins array<long>, ends array<long>")
    base = rows.select("row_", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    none = F.array().cast("array<long>")
    return base.join(cut, "row_", "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), F.coalesce("begins", none).alias("begins"), F.coalesce("ends", none).alias("ends"))


def op12_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("begins", "ends")

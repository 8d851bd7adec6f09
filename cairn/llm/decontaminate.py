"""Benchmark decontamination (operator 4): an FM-index per shard of documents; benchmark windows are
found by backward search, located by sampled suffix positions, and merged to removal spans."""

from __future__ import annotations

import functools
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import lean, mapped_bytes, read_table, slices, text_or_empty, work_dir, words_of
from .fm_index import FMIndex

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A-Z to lower case, then every ASCII byte but digits and letters to a space.
WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in _LOWER)
SPANS = "doc_id long, n_words long, n_hit long, spans array<struct<first:int,last:int>>, items array<string>, row "
#: Windows that are searched at a time.
TOGETHER = 1 << 18
#: Bytes of text that are split to words at a time, less than a shard's, so that a shard ends near its bound.
SLICE = 1 << 20
#: What the name of a block's words ends with.
WORDS = ".words"


class Windows:
    """Distinct windows of a block of benchmark items: where each begins in the items' symbols (from 1), its
    length, and the items it stands in. Takes some 30 bytes a word, and makes a row a window only to tell
    equal ones apart."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        flat, offsets = words_of(mapped_bytes(pa.array([t for _, t in items], pa.string()), WORD_BYTES))
        coded = flat.dictionary_encode()
        self.vocabulary, self.symbol = coded.dictionary, (coded.indices.to_numpy() + 1).astype(np.int32)
        size = np.diff(offsets)
        wide = np.minimum(size, window)
        count = np.where(size > 0, size - wide + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][item]
        length = wide[item]
        padded = np.append(self.symbol, np.zeros(window, np.int32))
        rows = np.where(np.arange(window) < length[:, None], padded[start[:, None] + np.arange(window)], 0).astype(np.int32)
        _, first, which = np.unique(rows.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True) if len(rows) else (None, start, start)
        self.start, self.length = start[first].astype(np.int64), length[first].astype(np.int64)
        names = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(names)}
        code = np.array([number.get(i, -1) for i, _ in items], np.int64)[item]
        pair = np.unique(np.ravel(which)[code >= 0] * np.int64(max(1, len(names))) + code[code >= 0])
        self.names, self.owner = names, (pair % max(1, len(names))).astype(np.int64)
        self.owner_at = np.searchsorted(pair // max(1, len(names)), np.arange(len(self.start) + 1))


def _write_block(uri: str, window: int):
    """Writes the windows of a task's items, and their words apart, and returns the file's name. A task that runs
    again writes another file; only the names that came back are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [pair for batch in batches for pair in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist())]
        if items:
            fs, root = pafs.FileSystem.from_uri(uri)
            name, block = f"{root}/{uuid.uuid4().hex}", Windows(items, window)
            for path, part in ((name, block), (name + WORDS, block.vocabulary)):
                with fs.open_output_stream(path) as sink:
                    sink.write(pickle.dumps(part))
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def _read(fs: pafs.FileSystem, name: str) -> Windows | pa.Array:
    with fs.open_input_stream(name) as file:
        return pickle.loads(file.read())


def _spans(uri: str, names: list[str], shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        read = functools.lru_cache(maxsize=2)(functools.partial(_read, fs))  # a block and its words

        def shard(ids: list[pa.Array], keys: list[pa.Array], coded: list[pa.DictionaryArray], sizes: list[np.ndarray]) -> pa.RecordBatch:
            size = np.concatenate(sizes)
            begins = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
            one = pa.chunked_array(coded).unify_dictionaries()
            words = one.chunk(0).dictionary
            known = np.zeros(len(words), bool)
            for name in names:
                known |= pc.is_in(words, read(name + WORDS)).to_numpy(zero_copy_only=False)
            code = np.where(known, np.cumsum(known), 0)
            symbol = code[np.concatenate([c.indices.to_numpy() for c in one.chunks])]
            text = np.insert(symbol, np.cumsum(size), 0)
            index = FMIndex(text, int(known.sum()))
            doc_of = np.repeat(np.arange(len(begins)), size + 1)
            edge, docs, items = np.zeros(len(text) + 1, np.int64), [np.zeros(0, np.int64)], [pa.array([], pa.string())]
            for name in names:
                block = read(name)
                here = pc.index_in(block.vocabulary, words)
                symbols = np.where(here.is_valid().to_numpy(zero_copy_only=False), code[here.fill_null(0).to_numpy()] if len(words) else 0, 0)[block.symbol - 1]
                lacks = np.concatenate(([0], np.cumsum(symbols == 0)))
                able = np.flatnonzero(lacks[block.start + block.length] == lacks[block.start])
                for w in range(0, len(able), TOGETHER):
                    part = able[w : w + TOGETHER]
                    start, length = block.start[part], block.length[part]
                    low, high = index.search(symbols, start, length)
                    n = high - low
                    pattern = np.repeat(np.arange(len(start)), n)
                    at = index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n))
                    edge += np.bincount(at, minlength=len(text) + 1) - np.bincount(at + length[pattern], minlength=len(text) + 1)
                    # each window once a document, then the items it stands in
                    met = np.unique(doc_of[at] * np.int64(len(start)) + pattern)
                    doc, pattern = met // len(start), part[met % len(start)]
                    k = block.owner_at[pattern + 1] - block.owner_at[pattern]
                    item = block.owner[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(block.owner_at[pattern], k)]
                    pair = np.unique(np.repeat(doc, k) * np.int64(max(1, len(block.names))) + item)
                    docs.append(pair // max(1, len(block.names)))
                    items.append(pa.array(block.names, pa.string()).take(pa.array(pair % max(1, len(block.names)))))
            hit = np.cumsum(edge)[:-1] > 0
            n_hit = np.add.reduceat(hit, begins, dtype=np.int64)
            turn = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
            first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            of = np.searchsorted(begins, first, "right") - 1
            span_at = np.searchsorted(of, np.arange(len(begins) + 1)).astype(np.int32)
            found = pa.concat_arrays(items).dictionary_encode()
            order = pc.sort_indices(found.dictionary).to_numpy()
            place, many = np.argsort(order), max(1, len(order))
            pair = np.unique(np.concatenate(docs) * np.int64(many) + place[found.indices.to_numpy()])
            item_at = np.searchsorted(pair // many, np.arange(len(begins) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array((x - begins[of]).astype(np.int32)) for x in (first, last)], ["first", "last"])
            listed = found.dictionary.take(pa.array(order[pair % many] if len(order) else pair))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(size), pa.array(n_hit), pa.ListArray.from_arrays(span_at, spans), pa.ListArray.from_arrays(item_at, listed), pa.concat_arrays(keys)],
                ["doc_id", "n_words", "n_hit", "spans", "items", "row"],
            )

        held: tuple[list, list, list, list] = ([], [], [], [])
        words = 0
        for batch in slices(batches, "text", SLICE):
            flat, offsets = words_of(mapped_bytes(batch.column("text"), WORD_BYTES))
            size = np.diff(offsets)
            for part, value in zip(held, (batch.column("doc_id"), batch.column("row"), flat.dictionary_encode(), size)):
                part.append(value)
            words += len(flat) + len(size)
            if words >= shard_words:
                yield shard(*held)
                held, words = ([], [], [], []), 0
        if held[0]:
            yield shard(*held)

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, shard_words: int = 1 << 19, block_bytes: int = 4 << 20
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the merged
    removal spans (word positions, end excluded) and item ids behind them.

    A null or empty text has no words and is clean, as is every document against an empty benchmark.
    Items of fewer than ``window`` words are one window; items without words match nothing. Items
    repeated with one id count once, and a null item id marks words but isn't listed. Repeated
    documents are each judged by themselves. Other columns aren't carried.

    Each task indexes shards of about ``shard_words`` words (one document at least) once, over the shard's own
    words that the benchmark has. Tasks make the benchmark's windows as files of about ``block_bytes`` of text (one
    item at least), as many as it needs, and each shard is searched for one file after another: a block of
    two-letter words and spaces takes some 40 MB in a task. Documents are read once, whatever the benchmark's size."""
    found = _judged(docs, benchmark, [], window, share, shard_words, block_bytes)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "spans", "items")


def contaminated_rows(rows: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, shard_words: int = 1 << 19, block_bytes: int = 4 << 20) -> DataFrame:
    """``row_`` of the rows (see ``with_rows``) that are contaminated."""
    return _judged(rows, benchmark, ["row_"], window, share, shard_words, block_bytes).filter("contaminated").select(F.col("row").alias("row_"))


def _judged(docs: DataFrame, benchmark: DataFrame, row: list[str], window: int, share: int, shard_words: int, block_bytes: int) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty(F.col("text")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    uri = work_dir(docs.sparkSession, "windows")
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root)
    blocks = items.repartition(max(1, -(-size // block_bytes)), "item_id", "text").mapInArrow(lean(_write_block(uri, window)), "name string")
    names = sorted(r.name for r in blocks.collect())  # a name for each block
    text = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"), *([F.col(r).alias("row") for r in row] or [F.lit("").alias("row")]))
    found = text.mapInArrow(lean(_spans(uri, names, shard_words)), SPANS + ("struct<file:long,at:long>" if row else "string"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 13) AS n FROM b) WHERE n > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
hits AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY 1)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

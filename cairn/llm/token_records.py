"""Token-id output (operator 1): length-delimited binary records with masked checksums, and a separate
offset index for shuffled reads."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crc
from ._work import read_table, slices, stored, text_or_empty, words_of, work_dir

END_ID = 1
#: Of a record: 8 bytes length, 4 its masked checksum, data, 4 the data's masked checksum.
HEAD, TAIL = 12, 4
READ_BYTES = 8 << 20


def frame(ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Records of the sequences ids[at[i]:at[i+1]] and where each begins."""
    data = ids.view(np.uint8)
    ends = at[1:].astype(np.int64) * ids.itemsize
    sizes = np.diff(ends, prepend=0)
    head = sizes.astype("<u8").view(np.uint8)
    head_crc = crc.masked(crc.crc32c(head, np.arange(1, len(sizes) + 1) * 8))
    data_crc = crc.masked(crc.crc32c(data, ends))
    begin = np.concatenate(([0], np.cumsum(sizes + HEAD + TAIL)))
    out = np.zeros(begin[-1], np.uint8)
    put = lambda where, width, values: out.__setitem__((where[:, None] + np.arange(width)).ravel(), values)
    put(begin[:-1], 8, head)
    put(begin[:-1] + 8, 4, head_crc.astype("<u4").view(np.uint8))
    out[np.arange(len(data)) + np.repeat(begin[:-1] + HEAD - (ends - sizes), sizes)] = data
    put(begin[1:] - TAIL, 4, data_crc.astype("<u4").view(np.uint8))
    return out.tobytes(), begin[:-1]


def unframe(raw: bytes, begin: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the records that begin at ``begin`` and fill ``raw``; raises on a wrong checksum."""
    got = np.frombuffer(raw, np.uint8)
    ends = np.append(begin[1:], len(got))
    take = lambda where, width, kind: np.ascontiguousarray(got[where[:, None] + np.arange(width)]).view(kind).ravel()
    sizes = take(begin, 8, "<u8").astype(np.int64)
    head = take(begin, 8, np.uint8)
    if (begin + HEAD + sizes + TAIL != ends).any() or (crc.masked(crc.crc32c(head, np.arange(1, len(begin) + 1) * 8)) != take(begin + 8, 4, "<u4")).any():
        raise ValueError("a record's length or its checksum is wrong")
    to = np.cumsum(sizes)
    data = got[np.arange(int(sizes.sum())) + np.repeat(begin + HEAD - (to - sizes), sizes)]
    if (crc.masked(crc.crc32c(data, to)) != take(ends - TAIL, 4, "<u4")).any():
        raise ValueError("a record's data checksum is wrong")
    ids = data.view(dtype)
    return ids, np.concatenate(([0], to // np.dtype(dtype).itemsize))


def _encoder(path: str, bounds: np.ndarray, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.coder(path)
        for batch in slices(batches, "text"):
            flat, offsets = words_of(batch.column("text"))
            coded = flat.dictionary_encode()
            ids, at = bpe.gathered(*words.lookup(coded.dictionary), coded.indices.to_numpy())
            offsets = at[offsets]
            ids = np.insert(ids, offsets[1:], END_ID).astype(dtype)
            offsets = offsets + np.arange(len(offsets))
            width = np.dtype(dtype).itemsize
            column = batch.column("doc_id")
            key = column.to_numpy(zero_copy_only=False).astype(np.float64)
            part = np.where(np.isnan(key), 0, np.searchsorted(bounds, np.nan_to_num(key), "left")).astype(np.int32)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([column, pa.array(part), binary.cast(pa.binary())], ["doc_id", "part", "ids"])

    return run


def _writer(uri: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        at, sink, index, tmp = None, None, None, ""
        total, position = [0, 0], 0

        def close() -> pa.RecordBatch:
            sink.close()
            index.close()
            for kind in ("rec", "idx"):
                fs.move(f"{tmp}.{kind}", f"{root}/{at:06d}.{kind}")
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([f"{root}/{at:06d}"]), pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.int64())], ["part", "file", "records", "tokens"])

        schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        for batch in slices(batches, "ids"):
            parts = batch.column("part").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(parts, prepend=-1)), len(parts))
            for a, b in zip(cuts, cuts[1:]):
                if parts[a] != at:
                    if at is not None:
                        yield close()
                    at, total, position = int(parts[a]), [0, 0], 0
                    tmp = f"{root}/tmp-{at:06d}-{uuid.uuid4().hex}"
                    sink, index = fs.open_output_stream(f"{tmp}.rec"), pq.ParquetWriter(f"{tmp}.idx", schema, filesystem=fs)
                rows = batch.slice(a, b - a)
                column = pa.concat_arrays([rows.column("ids")])
                offsets = np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1].astype(np.int64)
                ids = np.frombuffer(column.buffers()[2] or b"", dtype)
                count = np.diff(offsets) // np.dtype(dtype).itemsize
                raw, begin = frame(ids, offsets // np.dtype(dtype).itemsize)
                sink.write(raw)
                index.write_batch(pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(begin + position), pa.array(count)], schema=schema))
                position += len(raw)
                total[0] += len(count)
                total[1] += int(count.sum())
        if at is not None:
            yield close()

    return run


def write_token_records(docs: DataFrame, tokenizer: str, uri: str, vocab_size: int, files: int | None = None) -> DataFrame:
    """Encode every whole text, end it with id 1, and write record files in ascending doc_id order.

    Returns the manifest: part, file (its name without .rec and .idx), records, tokens. Null text is
    empty (the end id alone), null ids come first, rows repeated with an id follow each other. The ids
    are 16 or 32 bit by ``vocab_size``. A file is moved to its name when whole, so a task that runs
    again replaces it."""
    spark = docs.sparkSession
    dtype = "<u2" if vocab_size <= 1 << 16 else "<u4"
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("double"), [k / files for k in range(1, files)], 10000)).first()[0] if files > 1 else None
    bounds = np.unique(np.array(cuts or [], np.float64))
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root)
    text = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    encoded = text.mapInArrow(_encoder(tokenizer, bounds, dtype), "doc_id long, part int, ids binary")
    dealt = encoded.repartitionById(files, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    return stored(dealt.mapInArrow(_writer(uri, dtype), "part int, file string, records long, tokens long"), "manifest")


def read_token_records(spark: SparkSession, manifest: DataFrame, uri: str, vocab_size: int, with_ids: bool = False) -> DataFrame:
    """Read the files of a manifest back by their index, checking each checksum: doc_id, start (tokens
    before it in doc_id order), n_tokens, ids_crc32, and the ids if asked for."""
    dtype = "<u2" if vocab_size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                source, index = fs.open_input_file(f"{name}.rec"), pq.read_table(f"{name}.idx", filesystem=fs)
                offset, count = index["offset"].to_numpy(), index["n_tokens"].to_numpy()
                start = base + np.cumsum(count) - count
                ends, a = np.append(offset[1:], source.size()), 0
                while a < len(offset):
                    b = max(a + 1, int(np.searchsorted(ends, offset[a] + READ_BYTES, "right")))
                    source.seek(int(offset[a]))
                    ids, at = unframe(source.read(int(ends[b - 1] - offset[a])), offset[a:b] - offset[a], dtype)
                    wide = ids.astype("<u4")
                    sums = np.array([zlib.crc32(wide[x:y]) for x, y in zip(at, at[1:])], np.int64)
                    columns = [index["doc_id"].slice(a, b - a).combine_chunks(), pa.array(start[a:b]), pa.array(np.diff(at)), pa.array(sums)]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(wide.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    a = b

    ordered = manifest.selectExpr("part", "file", "sum(tokens) over (order by part) - tokens as base")
    files = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return ordered.repartition(files, "part").mapInArrow(run, schema)


def op1_token_records(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, vocab_size: int = 49408) -> DataFrame:
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    uri = work_dir(spark, "records")
    manifest = write_token_records(read_table(spark, sf_dir, "documents"), tokenizer, uri, vocab_size)
    return read_token_records(spark, manifest, uri, vocab_size)

"""Helpers shared by the training-data operators: the shared work folder, tables cut from their
lineage, and Arrow text splitting."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is unset and everything runs on one machine (tests) a temporary folder stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="cairn-"))
    return f"{base.rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def from_files(df: DataFrame) -> bool:
    """Whether each row is one row of a file that tells its place: nothing but choices of rows and columns stands
    above the scan, and the format numbers its rows."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    if not df.inputFiles() or not node.children().isEmpty():
        return False
    try:
        return bool(df.select(df.metadataColumn("_metadata")["row_index"]).columns)
    except AnalysisException:  # the place of a row is known in Parquet alone
        return False


def free_name(name: str, columns: list[str]) -> str:
    """The name, or one like it that no column has in any case of letters."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def placed(df: DataFrame) -> DataFrame:
    """The frame, written first unless its rows come straight from files that tell their places."""
    return df if from_files(df) else stored(df, "rows")


def with_rows(df: DataFrame, row: str = "row_") -> DataFrame:
    """The frame's columns and ``row``, which tells each row from every other, equal ones included: its file
    and its place in there. Two choices of columns of one ``placed`` frame give a row the same value. The frame
    has no column of that name (see ``free_name``)."""
    df = placed(df)
    place = df.metadataColumn("_metadata")
    return df.select("*", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(row))


def small_batches(spark: SparkSession, rows: int = 2000, most_bytes: int = 4 << 20) -> None:
    """Rows are whole texts here, so the session's Arrow batches become shorter than the default 10,000 rows, and
    end at ``most_bytes`` where Spark has a setting for that: a batch is held on both sides of each Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)  # one with a unit is the user's own
    if spark.conf.isModifiable(name) and (held is None or held.isdecimal() and int(held) > most_bytes):
        spark.conf.set(name, most_bytes)


def give_back() -> None:
    """Hand this process's freed memory back to the machine: Spark reuses workers from stage to stage, and what
    each of a pipeline's stages left in the allocators would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, which gives its memory back when a task ends."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def mapped_bytes(texts: pa.StringArray, table: bytes) -> pa.StringArray:
    """The same strings with every UTF-8 byte passed through a 256-byte table that leaves bytes
    over 127 alone, so offsets stay as they are."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    _, offsets, data = texts.buffers()
    moved = data.to_pybytes().translate(table) if data is not None else b""
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(moved))


def words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All ASCII-whitespace-separated words of the texts in one array, and where each text's begin."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = (offsets - offsets[0]).astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        before = np.concatenate(([0], np.cumsum(keep)))
        flat, offsets = flat.filter(full), before[offsets]
    return flat, offsets


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text (one row at least; a word of a list counts
    six bytes), so that memory follows the longest text and not the batch size."""
    for batch in batches:
        value = batch.column(column)
        nested = pa.types.is_list(value.type)
        size = (pc.multiply(pc.list_value_length(value), 6) if nested else pc.binary_length(value)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, cut = 0, np.cumsum(size)
        while at < batch.num_rows:
            base = cut[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(cut, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to

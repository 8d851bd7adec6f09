"""Corpus pipeline: toxic documents go, exact and near copies leave one document each, contaminated
documents go, and what is left is encoded and decoded. Each stage takes and returns whole tables.

Every row is judged by itself, whatever its doc_id and its other columns are called: a stage finds the rows
that go by their place in its input's files, and all others pass without a shuffle of their texts. Null texts
count as empty, empty tables give empty ones, and columns stay as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe_table, decontaminate, exact_dedup, near_dedup, toxicity
from cairn.llm._work import free_name, placed, read_table, stored, with_rows
from cairn.llm.bloom import without_rows


def _without(docs: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``found`` doesn't tell of (doc_id, text, row_); it sees no other column."""
    docs = placed(docs)
    row = free_name("row_", docs.columns)
    return without_rows(with_rows(docs, row), found(with_rows(docs.select("doc_id", "text"))), row=row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under 0.3 stay; labels teach through their doc_id."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays; a null id stays if all are null."""
    return _without(docs, exact_dedup.exact_copies)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies that are linked one row with the least doc_id stays, a null id if all are null. Texts without
    words stay."""
    return _without(docs, near_dedup.near_copies)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay unless benchmark windows cover at least a twentieth of their words."""
    return _without(docs, lambda rows: decontaminate.contaminated_rows(rows, read_table(spark, sf_dir, "benchmark")))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe_table.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode_and_decode),
]
#: The trained first stage has no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

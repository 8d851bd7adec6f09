"""Exact dedup (operator 9): two-pass Bloom filtering finds rows whose text may be repeated; only
their (hash, id) pairs shuffle, all other rows pass straight through."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from ._work import read_table, stored, text_or_empty


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, most_bits: int = 1 << 30, salts: int = 64
) -> DataFrame:
    """One row per input row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are equal to each other. Texts are equal when their
    bytes are (SHA-256). Rows repeated with one id are counted in group_size and marked alike. Null ids
    never win against an id; a group of null ids only keeps them all. An empty table gives an empty
    table. Other columns are not carried, so clashing names cannot arise.

    Pass one sets two-bit counters in Bloom filters of ``bits_per_row`` bits a row. Each filter covers a
    range of hashes and has at most ``most_bits`` (the bound of a broadcast, 128 MB); there are as many as the
    rows need, and hashes lie sorted in their files, so each reads its range alone. Equal rows are
    pre-aggregated under ``salts`` salts, so a text with any share of the rows spreads out."""
    found = _marked(docs, id_col, text_col, [], bits_per_row, most_bits, salts)
    return found.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_copies(rows: DataFrame, bits_per_row: int = 16, most_bits: int = 1 << 30, salts: int = 64) -> DataFrame:
    """``row_`` of the rows (see ``with_rows``) that are copies: of equal texts, all but one row with the
    largest doc_id."""
    found = _marked(rows, "doc_id", "text", ["row_"], bits_per_row, most_bits, salts)
    return found.filter(F.col("row_") != F.col("keep_row")).select("row_")


def _marked(docs: DataFrame, id_col: str, text_col: str, row: list[str], bits_per_row: int, most_bits: int, salts: int) -> DataFrame:
    text = text_or_empty(F.col(text_col))
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("sha"), *row)
    hashed = stored(hashed.sortWithinPartitions("h"), "hashes")
    n = hashed.count()
    ranges = max(1, -(-n * bits_per_row // most_bits))
    bits, parts = bloom.filter_bits(-(-n // ranges), bits_per_row, most_bits), []
    edge = [(k << 64) // ranges - (1 << 63) for k in range(ranges)]
    for k, low in enumerate(edge):
        part = hashed.filter(F.col("h") >= low) if k + 1 == ranges else hashed.filter((F.col("h") >= low) & (F.col("h") < edge[k + 1]))
        twice = bloom.build(part.select("h"), bits, least=2)
        parts.append(part.select("doc_id", "sha", *row, bloom.might_contain(twice, bits, F.col("h")).alias("maybe")))
    rows = stored(functools.reduce(DataFrame.unionByName, parts), "marked")

    own = [F.col(r).alias("keep_row") for r in row]
    alone = rows.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha", *row, *own)
    maybe = rows.filter("maybe").withColumn("salt", F.pmod(F.xxhash64("doc_id", *row), F.lit(salts)).cast("int"))
    part = maybe.groupBy("sha", "salt").agg(F.max(F.struct("doc_id", *row)).alias("top"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("sha").agg(F.max("top").alias("top"), F.sum("n").alias("group_size"))
    salted = part.select("sha", "salt").join(whole, "sha")
    again = maybe.join(salted, ["sha", "salt"]).select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", "sha", *row, *(F.col(f"top.{r}").alias("keep_row") for r in row))
    return alone.unionByName(again)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

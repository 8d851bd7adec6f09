"""BPE encoding and decoding (operator 3) through a distinct-word table: words are split in Spark, each
distinct word is encoded once, ids return by position; decoding goes through an id-to-piece table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ._work import from_files, lean, read_table, slices, stored, text_or_empty, work_dir

#: White space of Unicode as the tokenizer's word pattern knows it, and that pattern.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Bytes of text that a task turns to ids and back at a time.
SLICE = 1 << 20


def added_tokens(tokenizer: str) -> list[str]:
    with open(tokenizer, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def split_words(text: Column, added: list[str]) -> Column:
    """The words of a text in order; joined they are the text. An added token's string stands alone: the
    text around it is split as if it ended there."""
    words = lambda t: F.regexp_extract_all(t, F.lit(WORD), 0)
    if not added:
        return words(text)
    quoted = "|".join("\\Q" + a + "\\E" for a in sorted(added, key=len, reverse=True))
    between = F.split(text, quoted)
    marks = F.regexp_extract_all(text, F.lit(quoted), 0)
    parts = F.flatten(F.transform(between, lambda t, i: F.concat(words(t), F.when(i < F.size(marks), F.array(F.get(marks, i))).otherwise(F.array().cast("array<string>")))))
    return F.when(text.rlike(quoted), parts).otherwise(words(text))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word) once for each block that a task reads."""
    at, held = None, pa.array([], pa.string())
    pairs = lambda: pa.RecordBatch.from_arrays([pa.array(np.full(len(held), at, np.int64)), held], ["block", "word"])
    for batch in slices(batches, "words"):
        blocks = batch.column("block").to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1)), len(blocks))
        for a, b in zip(cuts, cuts[1:]):
            if blocks[a] != at and at is not None:
                yield pairs()
                held = held[:0]
            at = int(blocks[a])
            held = pc.unique(pa.concat_arrays([held, pc.unique(batch.slice(a, b - a).column("words").flatten())]))
    if at is not None:
        yield pairs()


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(tokenizer)
        last: tuple[str, bytes] | None = None  # the rows of a word can run on into the next batch
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = words[1:] if last and words[0] == last[0] else words
            ids = [] if new is words else [last[1]]
            for a in range(0, len(new), 4096):
                ids += [np.array(e.ids, "<u4").tobytes() for e in coder.encode_batch_fast(new[a : a + 4096], add_special_tokens=False)]
            last = words[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("word"), pa.array(ids, pa.binary()).take(coded.indices)], ["block", "word", "ids"])

    return run


def id_pieces(tokenizer: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary: the id-to-piece table, bounded by the vocabulary."""
    byte_of = {chr(letter): b for b, letter in bpe.BYTE_LETTERS.items()}
    coder = bpe.load(tokenizer)
    plain = {t["id"]: t["content"].encode() for t in json.loads(coder.to_str())["added_tokens"]}
    size = coder.get_vocab_size(with_added_tokens=True)
    return [plain[i] if i in plain else bytes(byte_of[c] for c in coder.id_to_token(i) or "") for i in range(size)]


def _apply(uri: str, pieces: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        table = pieces.value
        piece_flat, piece_at = np.frombuffer(b"".join(table), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in table])))
        loaded: int | None = None
        words, flat, at = pa.array([], pa.string()), np.array([], "<u4"), np.array([0])

        def load(block: int) -> None:
            nonlocal words, flat, at, loaded
            found = pads.dataset(f"{root}/block={block}", filesystem=fs, format="parquet").to_table(columns=["word", "ids"])
            words = found["word"].combine_chunks()
            ids = found["ids"].combine_chunks()
            flat = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
            at = np.concatenate(([0], np.cumsum(pc.binary_length(ids).to_numpy() // 4)))
            loaded = block

        for batch in slices(batches, "words", SLICE):
            blocks = batch.column("block").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1)), len(blocks))
            for a, b in zip(cuts, cuts[1:]):
                rows = batch.slice(a, b - a)
                lists = rows.column("words")
                value = lists.flatten()
                offsets = lists.offsets.to_numpy().astype(np.int64)
                offsets -= offsets[0]
                if len(value) and loaded != blocks[a]:
                    load(int(blocks[a]))
                coded = value.dictionary_encode()
                slot = pc.index_in(coded.dictionary, words).to_numpy(zero_copy_only=False)
                if np.isnan(slot.astype(np.float64)).any():
                    raise ValueError("a word is missing from its block of the word table")
                ids, to = bpe.gathered(flat, at, slot.astype(np.int64)[coded.indices.to_numpy()]) if len(value) else (flat[:0], np.array([0]))
                doc = to[offsets]
                raw, end = bpe.gathered(piece_flat, piece_at, ids)
                wide, raw, cut = ids.astype("<u4"), raw.tobytes(), end[doc]
                id_hash = [hashlib.sha256(wide[x:y]).hexdigest() for x, y in zip(doc, doc[1:])]
                text_hash = [hashlib.sha256(raw[x:y].decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(doc)), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text is empty: no ids, the hash of nothing. Repeated rows are each encoded; ids may be null;
    other columns aren't carried. An empty table gives an empty one.

    A block is a stretch of an input file (its name and the start of its split). The word table has
    each distinct word beside the blocks it occurs in; a word's rows lie together, so it is encoded
    once. The coded table is written by block to the shared folder, and the task that holds a block's
    texts joins them by position to that block's words alone. So words shuffle
    once a block, texts never, and nothing that grows is broadcast. Rows that do not come straight from
    files are first written to the shared folder."""
    spark = docs.sparkSession
    if not from_files(docs):
        docs = stored(docs.select("doc_id", "text"), "texts")
    place = F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("block")
    split = docs.select("doc_id", split_words(text_or_empty(F.col("text")), added_tokens(tokenizer)).alias("words"), place)
    words = split.select("block", "words").mapInArrow(lean(_distinct), "block long, word string")
    table = words.repartition("word").sortWithinPartitions("word").mapInArrow(lean(_encode(tokenizer)), "block long, word string, ids binary")
    uri = work_dir(spark, "words")
    table.repartition("block").write.partitionBy("block").parquet(uri)
    pieces = spark.sparkContext.broadcast(id_pieces(tokenizer))
    return split.mapInArrow(lean(_apply(uri, pieces)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_table(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_decode(read_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))

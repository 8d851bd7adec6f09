"""Line dedup (operator 8): a fixed-depth log-template tree. Lines are parsed by token count and leading
tokens, variable fields are generalised, and lines whose template recurs across documents are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from ._work import read_table, slices, stored, text_or_empty

WILD = "<*>"


class Leaf:
    """Templates of one leaf, as columns of token numbers (0 is the wildcard), in the order they came.

    A line that may join a template differs from it in few places, all behind the leading tokens. So of the lists of
    templates that hold the line's token in a place, all but as many lists have the template; it is in one of the
    shortest, one more than places may differ. Tokens that all lines share make long lists, which stay closed.

    Lists lie in sorted levels, each at least four times as long as the next. Templates that came or changed since are
    compared one by one, ``FRESH`` at most."""

    FRESH = 256

    def __init__(self, width: int, depth: int, percent: int):
        self.rows, self.used, self.depth = np.zeros((width, 4), np.int32), 0, depth
        self.code: dict[str, int] = {WILD: 0}
        self.need = -(-percent * width // 100)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.fresh: list[int] = []

    def _entries(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted (place, token) keys of the templates, and the template of each."""
        tail = self.rows[self.depth :, numbers].astype(np.int64)
        key = (tail + (np.arange(len(tail), dtype=np.int64) << 32)[:, None]).ravel()
        order = np.argsort(key, kind="stable")
        return key[order], np.tile(numbers, len(tail))[order].astype(np.int32)

    def _put(self, number: int) -> None:
        if number in self.fresh:
            return
        self.fresh.append(number)
        if len(self.fresh) == self.FRESH:
            self.levels.append(self._entries(np.array(self.fresh)))
            self.fresh = []
            while len(self.levels) > 1 and len(self.levels[-2][0]) < 4 * len(self.levels[-1][0]):
                # templates that changed are taken up as they are now, once
                both = np.unique(np.concatenate((self.levels.pop()[1], self.levels.pop()[1])))
                self.levels.append(self._entries(both))

    def _near(self, row: np.ndarray, places: np.ndarray, misses: int) -> np.ndarray:
        """Templates, in order, with all that hold the line's tokens in all but ``misses`` of these places."""
        if misses >= len(places) or not self.levels:
            return np.arange(self.used)
        key = row[places] + ((places - self.depth) << 32)
        found = [np.array(self.fresh, np.int32)]
        for keys, numbers in self.levels:
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            size = high - low
            for k in np.argpartition(size, misses)[: misses + 1] if misses + 1 < len(size) else range(len(size)):
                if size[k]:
                    found.append(numbers[low[k] : high[k]])
        return np.unique(np.concatenate(found))

    def _best(self, row: np.ndarray, among: np.ndarray) -> tuple[int, int, int]:
        """The template with most places that hold the line's constants, then most wildcards, then the first;
        with the number of such places and of masked fields that meet a wildcard."""
        rows = self.rows[:, among]
        equal, none = rows == row[:, None], rows == 0
        same = (equal & ~none).sum(axis=0)
        best = int(np.argmax(same * (len(row) + 1) + none.sum(axis=0)))
        return int(among[best]), int(same[best]), int((equal & none)[:, best].sum())

    def add(self, tokens: list[str]) -> int:
        """Number of the template that the line joins: the most alike (first among equals) if enough
        places agree, else a new one. Places that differ become wildcards."""
        row = np.array([self.code.setdefault(t, len(self.code)) for t in tokens], np.int64)
        near = self._near(row, np.arange(self.depth, len(row)), len(row) - self.need)
        if len(near):
            best, same, both = self._best(row, near)
            if same + both >= self.need > same + int((row[: self.depth] == 0).sum()):
                # enough only by masked fields further back: a template elsewhere may hold as many constants
                constant = np.flatnonzero(row[self.depth :]) + self.depth
                misses = len(constant) - (same - int((row[: self.depth] > 0).sum()))
                best, same, both = self._best(row, np.union1d(near, self._near(row, constant, misses)))
            if same + both >= self.need:
                differs = (self.rows[:, best] != row) & (self.rows[:, best] > 0)
                if differs.any():
                    self.rows[differs, best] = 0
                    self._put(best)
                return best
        if self.used == self.rows.shape[1]:
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)), axis=1)
        self.rows[:, self.used] = row
        self.used += 1
        self._put(self.used - 1)
        return self.used - 1


def _grow(depth: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaves = None, {}
        for batch in batches:
            number = []
            for key, tokens in zip(batch.column("leaf").to_pylist(), batch.column("tokens").to_pylist()):
                if key != at:
                    at, leaves = key, {}
                width = len(tokens)  # leaves of other widths with one hash stay apart
                if width not in leaves:
                    leaves[width] = Leaf(width, depth, percent)
                number.append((width << 32) + leaves[width].add(tokens))
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("line"), batch.column("docs"), pa.array(number, pa.int64())], ["leaf", "line", "docs", "template"])

    return run


def masked(lines: pa.StringArray) -> pa.StringArray:
    """The tokens of each line, one space apart; those with a digit are variable fields."""
    digits = pc.match_substring_regex(lines, "[0-9]")
    if pc.any(digits).as_py():
        lines = pc.replace_with_mask(lines, digits, pc.replace_substring_regex(lines.filter(digits), r"[^ \t\r\f\v]*[0-9][^ \t\r\f\v]*", WILD))
    loose = pc.match_substring_regex(lines, r"[\t\r\f\v]|  |^ | $")
    if pc.any(loose).as_py():
        lines = pc.replace_with_mask(lines, loose, pc.utf8_trim(pc.replace_substring_regex(lines.filter(loose), r"[ \t\r\f\v]+", " "), " "))
    return lines


def _parse(least_tokens: int, depth: int):
    """Each line of a text with its leaf: its place, the hashes of the leaf and of the masked line, and that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lists = pc.split_pattern(batch.column("text"), "\n")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(lists)), np.diff(offsets))
            pos = np.arange(len(doc)) - (offsets - offsets[0])[doc]
            shown = masked(lists.flatten())
            leaf, line = np.zeros((2, len(doc)), np.uint64)
            keep = np.zeros(len(doc), bool)
            for k, text in enumerate(shown.to_pylist()):
                size = text.count(" ") + 1 if text else 0
                if size >= least_tokens:
                    keep[k], line[k] = True, xxhash.xxh3_64_intdigest(text)
                    leaf[k] = xxhash.xxh3_64_intdigest(f"{size} {' '.join(text.split(' ', depth)[:depth])}")
            at = np.flatnonzero(keep)
            rows = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("h").take(rows), pa.array(pos[at].astype(np.int32)), pa.array(leaf[at].view(np.int64)), pa.array(line[at].view(np.int64)), shown.take(pa.array(at))],
                ["doc_id", "h", "pos", "leaf", "line", "shown"],
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines at the places in ``gone``."""
    for batch in slices(batches, "text"):
        left, total, dropped = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            lines = text.split("\n")
            total.append(len(lines))
            gone = set(gone or ())
            dropped.append(len(gone))
            left.append("\n".join(t for k, t in enumerate(lines) if k not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(left, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def line_dedup(docs: DataFrame, least_docs: int = 3, least_tokens: int = 3, depth: int = 3, percent: int = 80, most_bits: int = 1 << 30) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, text (what is left, in order).

    A line of ``least_tokens`` or more tokens goes to the leaf of its token count and first ``depth``
    tokens. In a leaf, distinct lines join templates one by one, the most frequent first (then by their
    text), where ``percent`` of the places agree. A template that occurs in ``least_docs`` different
    documents recurs, and all its lines are dropped. Shorter and blank lines stay.

    Null and empty texts have one empty line, which stays. Rows repeated with one id and text are one
    document and are cut alike; equal texts under other ids are other documents. Null ids are a document
    for each text. Other columns aren't carried; an empty table gives an empty one.

    Lines are parsed once, where their text is. A bounded Bloom filter finds leaves that may hold two lines;
    only theirs shuffle. Only distinct masked lines of leaves that can recur reach the tree, in one pass
    of sorted groups that holds a leaf's templates, not its lines. Counts of hot lines are summed before
    they shuffle."""
    text = text_or_empty(F.col("text"))
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    lines = stored(base.mapInArrow(_parse(least_tokens, depth), "doc_id long, h long, pos int, leaf long, line long, shown string"), "lines")
    bits = bloom.filter_bits(lines.count(), 16, most_bits)
    twice = bloom.build(lines.select(F.col("leaf").alias("h")), bits, least=min(2, least_docs))
    lines = stored(lines.filter(bloom.might_contain(twice, bits, F.col("leaf"))), "shared")

    count = stored(lines.select("doc_id", "h", "leaf", "line").distinct().groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs")), "count")
    open_ = count.groupBy("leaf").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least_docs).select("leaf")
    shown = lines.select("leaf", "line", "shown").dropDuplicates(["leaf", "line"])
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = shown.join(count.join(open_, "leaf", "left_semi"), ["leaf", "line"]).repartition(tasks, "leaf").sortWithinPartitions("leaf", F.desc("docs"), "shown")
    order = order.select("leaf", "line", "docs", F.split("shown", " ").alias("tokens"))
    tree = stored(order.mapInArrow(_grow(depth, percent), "leaf long, line long, docs long, template long"), "tree")

    # a line in enough documents settles its template; so does a sum that is too low
    sums = stored(tree.groupBy("leaf", "template").agg(F.max("docs").alias("most"), F.sum("docs").alias("all")).filter(F.col("all") >= least_docs), "sums")
    unsure = tree.join(sums.filter(F.col("most") < least_docs), ["leaf", "template"], "left_semi")
    seen = lines.select("doc_id", "h", "leaf", "line").join(unsure, ["leaf", "line"]).select("leaf", "template", "doc_id", "h").distinct()
    seen = seen.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs)
    recurs = sums.filter(F.col("most") >= least_docs).select("leaf", "template").unionByName(seen.select("leaf", "template"))
    gone = stored(tree.join(recurs, ["leaf", "template"], "left_semi").select("leaf", "line"), "gone")
    dropped = lines.select("doc_id", "h", "pos", "leaf", "line").join(gone, ["leaf", "line"], "left_semi")
    dropped = dropped.groupBy(F.col("doc_id").alias("id_"), F.col("h").alias("h_")).agg(F.collect_set("pos").alias("gone"))
    out = base.join(dropped, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    return out.select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id long, n_lines long, n_dropped long, text string")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template that two documents share is dropped, lines of one and two tokens included: their leaves
    are as deep as they are long, so they recur only as equal masked lines."""
    return line_dedup(read_table(spark, sf_dir, "documents"), least_docs=2, least_tokens=1)

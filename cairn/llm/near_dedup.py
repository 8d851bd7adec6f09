"""MinHash near-dedup (operator 7): circulant MinHash makes all signature coordinates from two
permutations; bands give candidates, and exact Jaccard similarity on full shingle sets confirms links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bloom
from ._work import lean, mapped_bytes, read_table, slices, stored, text_or_empty, words_of
from .components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
ROWS, BANDS = 4, 32
#: Candidates whose signatures agree on fewer coordinates are not verified: a pair at similarity 0.8
#: falls below with probability 3e-6; one that shares no band is missed with probability 5e-8.
LEAST_AGREEING = 82
PIVOTS, BLOCK, PER_TASK = 16, 4096, 500
#: Members of a bucket that meet the pivots in one task.
DEALT = 50_000
#: Coordinates of the signatures that settle what is left, and how many of them must agree for a pair to be in
#: doubt or surely alike: 4.5 standard deviations below and above a pair at similarity 0.8.
FINE, IN_DOUBT, SURE = 1024, 762, 877
#: Bytes of text whose shingles a task holds at a time.
SLICE = 2 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[4]
    x = (x ^ (x >> np.uint64(29))) * _ODD[5]
    return x ^ (x >> np.uint64(32))


def _permute(x: np.ndarray, out: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers (each step can be undone)."""
    np.right_shift(x, 16, out=tmp)
    np.bitwise_xor(x, tmp, out=out)
    np.multiply(out, np.uint32(0x85EBCA6B), out=out)
    np.right_shift(out, 13, out=tmp)
    np.bitwise_xor(out, tmp, out=out)
    np.multiply(out, np.uint32(0xC2B2AE35), out=out)
    np.right_shift(out, 16, out=tmp)
    return np.bitwise_xor(out, tmp, out=out)


def shingle_sets(texts: pa.StringArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text one after another, and where each begins."""
    flat, offsets = words_of(mapped_bytes(texts, LOWER))
    coded = flat.dictionary_encode()
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = word[coded.indices.to_numpy()] if len(flat) else np.array([], np.uint64)
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(count)))
    begin = np.repeat(offsets[:-1] - at[:-1], count) + np.arange(at[-1])
    short = np.repeat(np.minimum(n, width), count)
    total = _ODD[6] * short.astype(np.uint64)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    for k in range(width):
        total += np.where(short > k, _mix(padded[begin + k] + _ODD[7]) * _ODD[k], np.uint64(0))
    value, doc = _mix(total), np.repeat(np.arange(len(n)), count)
    order = np.argsort(value)
    order = order[np.argsort(doc[order], kind="stable")]
    value, doc = value[order], doc[order]
    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))[: len(value)]
    return value[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(n)))))


def signatures(value: np.ndarray, at: np.ndarray, size: int, chunk: int = 1 << 16) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least pi(sigma(x) + k), the second permutation shifted
    circularly k places over the first. Empty sets keep zeros."""
    out = np.zeros((len(at) - 1, size), np.uint32)
    x = (value >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x2545F491)
    sigma = _permute(x, np.empty_like(x), np.empty_like(x))
    full = np.flatnonzero(np.diff(at))
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(at[full], at[full[a]] + chunk)))
        docs = full[a:b]
        part = sigma[at[docs[0]] : at[docs[-1] + 1]]
        starts, shifted, held, tmp = at[docs] - at[docs[0]], np.empty_like(part), np.empty_like(part), np.empty_like(part)
        for k in range(size):
            np.add(part, np.uint32(k), out=shifted)
            out[docs, k] = np.minimum.reduceat(_permute(shifted, held, tmp), starts)
        a = b
    return out


def _describe(width: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            value, at = shingle_sets(batch.column("text"), width)
            sign = signatures(value, at, ROWS * BANDS)
            rows = sign.reshape(-1, BANDS, ROWS).astype(np.uint64)
            band = _mix((rows * _ODD[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[6])
            digest = [xxhash.xxh3_128_digest(value[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keys), pa.array(np.diff(at)), pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(band) + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).ravel())),
                    pa.array([r.tobytes() for r in sign.astype(np.uint8)], pa.binary()),
                ], [*keys, "n", "digest", "bands", "sig"],
            )

    return run


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of rows with equal keys, as (first part of its group, rows); whole groups if ``most`` is None,
    else parts as the batches hold them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows])) if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(key[:, a])
            if most is not None:
                yield now != last, batch.slice(a, b - a)
            elif now != last and held:
                yield True, pa.concat_batches(held)
                held = []
            if most is None:
                held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield True, pa.concat_batches(held)


PAIR = "a long, b long, agree int"


def _pairs(a: list, b: list, agree: list) -> pa.RecordBatch:
    cat = lambda x, t: pa.array(np.concatenate(x).astype(t)) if x else pa.array([], pa.from_numpy_dtype(t))
    return pa.RecordBatch.from_arrays([cat(a, np.int64), cat(b, np.int64), cat(agree, np.int32)], ["a", "b", "agree"])


def _with_pivots(percent: int):
    """Each row of a bucket with its best match among the bucket's first rows: linear in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot_sig, pivot_id, pivot_n = np.zeros((0, ROWS * BANDS), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        out: tuple[list, list, list] = ([], [], [])
        for first, rows in _groups(batches, ["key", "salt"], most=0):
            rep, n, sig = rows.column("rep").to_numpy(), rows.column("n").to_numpy(), _sig(rows.column("sig"))
            if first:
                pivot_sig, pivot_id, pivot_n = sig[:0], rep[:0], n[:0]
            more = PIVOTS - len(pivot_id)
            begin = len(pivot_id)
            if more > 0:
                pivot_sig, pivot_id, pivot_n = np.concatenate((pivot_sig, sig[:more])), np.concatenate((pivot_id, rep[:more])), np.concatenate((pivot_n, n[:more]))
            for a in range(0, len(rep), 1024):
                part = slice(a, a + 1024)
                agree = (sig[part, None, :] == pivot_sig[None]).sum(axis=2, dtype=np.int32)
                own = np.arange(len(agree)) + a + begin
                agree[~_fits(n[part, None], pivot_n[None], percent) | (np.arange(len(pivot_id))[None] >= own[:, None]) | (rep[part, None] == pivot_id[None])] = -1
                best = agree.argmax(axis=1)
                score = agree[np.arange(len(best)), best]
                hit = score >= LEAST_AGREEING
                if hit.any():
                    for o, v in zip(out, (pivot_id[best[hit]], rep[part][hit], score[hit])):
                        o.append(v)
            if sum(map(len, out[0])) > 50_000:
                yield _pairs(*out)
                out = ([], [], [])
        yield _pairs(*out)

    return run


class _Union:
    """Sets of small numbers that grow together."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.of(x), self.of(y)
        self.up[x] = y
        return x != y


def _across(percent: int):
    """Pairs between a block of a bucket's outsiders (rows outside its largest component) and a block of all its
    rows that fine signatures leave open: of those surely alike as many as join the components, and all in
    doubt between components that stay apart. A pair is judged in the first bucket it shares alone, so it
    comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ["key", "i", "j"]):
            rep, n, comp = (rows.column(c).to_numpy() for c in ("rep", "n", "comp"))
            asks, out = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "outside"))
            fine = _sig(rows.column("fine"))
            bands = rows.column("bands").flatten().to_numpy().reshape(len(rep), -1)
            key = rows.column("key")[0].as_py()
            names, code = np.unique(comp, return_inverse=True)
            asking, asked = np.flatnonzero(asks), np.flatnonzero(~asks)
            found: list[tuple] = [(np.zeros(0, np.int64),) * 3]
            for a in range(0, len(asking), 64):
                part = asking[a : a + 64]
                ok = (code[part, None] != code[None, asked]) & _fits(n[part, None], n[None, asked], percent)
                # two outsiders meet twice
                ok &= ~out[None, asked] | (rep[part, None] < rep[None, asked])
                x, y = np.nonzero(ok)
                for c in range(0, len(x), 1 << 14):
                    u, v = part[x[c : c + (1 << 14)]], asked[y[c : c + (1 << 14)]]
                    agree = (fine[u] == fine[v]).sum(axis=1, dtype=np.int64)
                    hit = agree >= IN_DOUBT
                    found.append((u[hit], v[hit], agree[hit]))
            u, v, agree = (np.concatenate(f) for f in zip(*found))
            order = np.argsort(-agree, kind="stable")
            u, v, agree = u[order], v[order], agree[order]
            same, keep = _Union(len(names)), np.zeros(len(u), bool)
            sure = int(np.searchsorted(-agree, -SURE, "right"))
            for k in range(sure):
                keep[k] = same.join(code[u[k]], code[v[k]])
            first = bands[u[sure:]] == bands[v[sure:]]
            here = bands[u[sure:], first.argmax(axis=1)] == key if len(first) else first[:, 0]
            root = np.array([same.of(c) for c in range(len(names))])
            keep[sure:] = here & (root[code[u[sure:]]] != root[code[v[sure:]]])
            u, v = u[keep], v[keep]
            yield _pairs([np.maximum(rep[u], rep[v])], [np.minimum(rep[u], rep[v])], [agree[keep]])

    return run


def _fine(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sign = signatures(*shingle_sets(batch.column("text"), width), FINE)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([r.tobytes() for r in sign.astype(np.uint8)], pa.binary())], ["rep", "fine"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            value, at = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([value[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["rep", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.array([], np.uint64)
        for first, rows in _groups(batches, ["a", "salt"], most=0):
            sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
            ids, skip = rows.column("b").to_pylist(), 0
            if first:
                one, skip = sets[0], 1
            linked = []
            for b, s in zip(ids[skip:], sets[skip:]):
                same = len(np.intersect1d(one, s, assume_unique=True))
                linked.append(100 * same >= percent * (len(one) + len(s) - same))
            yield pa.RecordBatch.from_arrays([rows.column("a").slice(skip), pa.array(ids[skip:], pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def texts_of(ids: DataFrame, docs: DataFrame, most_bits: int) -> DataFrame:
    """(rep, text) of the classes (rep, doc_id, xh). A bounded Bloom filter keeps all other texts out of the shuffle."""
    need = stored(ids.dropDuplicates(["rep"]), "need")
    bits = bloom.filter_bits(need.count(), 16, most_bits)
    key = F.xxhash64("doc_id", "xh")
    held = bloom.build(need.select(key.alias("h")), bits, least=1)
    near = docs.filter(bloom.might_contain(held, bits, key))
    need = need.select("rep", F.col("doc_id").alias("lead"), F.col("xh").alias("lead_xh"))
    return near.join(need, F.col("doc_id").eqNullSafe(F.col("lead")) & (F.col("xh") == F.col("lead_xh"))).dropDuplicates(["rep"]).select("rep", "text")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, most_bits: int) -> DataFrame:
    """(a, b, linked) of candidate pairs by exact Jaccard similarity of full shingle sets.

    Only texts of candidates move. Partners of one document are dealt under salts of ``PER_TASK`` each,
    with the document's set first in each."""
    n = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).cast("int").alias("salts"))
    dealt = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    texts = texts_of(classes.join(ids, "rep", "left_semi"), docs, most_bits)
    sets = stored(texts.mapInArrow(lean(_sets(width)), "rep long, shingles binary"), "sets")
    left = n.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets.withColumnRenamed("rep", "a"), "a").select("a", "salt", F.lit(0).alias("turn"), F.col("a").alias("b"), "shingles")
    right = dealt.join(sets.withColumnRenamed("rep", "b"), "b").select("a", "salt", F.lit(1).alias("turn"), "b", "shingles")
    met = left.unionByName(right)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(met.repartition(tasks, "a", "salt").sortWithinPartitions("a", "salt", "turn").mapInArrow(lean(_confirm(percent)), "a long, b long, linked boolean"), "verified")


def near_dedup(docs: DataFrame, width: int = 4, percent: int = 80, salts: int = 64, most_bits: int = 1 << 30) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id reachable by links), kept.

    Null and empty texts and texts without words have no shingles and link with nothing, each its own
    component. Texts with equal shingle sets are one class, whatever its size; only one of its rows with the
    least id goes on. Rows with a null id are linked as others are; a component of
    null ids alone has a null component_id. Repeated rows are in one
    class; rows of one id with other texts are judged by their texts. Other columns aren't carried. An empty
    table gives an empty one.

    Buckets are never expanded into pairs: each member meets at most ``PIVOTS`` members of its bucket
    first. What these links leave outside a bucket's largest component is then compared with its rows in
    blocks of ``BLOCK`` rows by signatures of ``FINE`` coordinates, and only pairs that can still matter leave
    the task; so no link between sharers of a band is given up. Hot buckets, classes and hubs are salted."""
    return _linked(docs, [], width, percent, salts, most_bits).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_copies(rows: DataFrame, width: int = 4, percent: int = 80, salts: int = 64, most_bits: int = 1 << 30) -> DataFrame:
    """``row_`` of the rows (see ``with_rows``) that are near copies: of each component, all but one row with the
    least doc_id, or with none if all ids are null. Rows without shingles stay."""
    found = stored(_linked(rows, ["row_"], width, percent, salts, most_bits).filter("component is not null").select("row_", "doc_id", "component"), "linked")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_")
    top = found.groupBy("component").agg(F.min(order).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(top, "component").filter(F.col("row_") != F.col("top.row_")).select("row_")


def _linked(docs: DataFrame, row: list[str], width: int, percent: int, salts: int, most_bits: int) -> DataFrame:
    text = docs.select("doc_id", *row, text_or_empty(F.col("text")).alias("text")).withColumn("xh", F.xxhash64("text"))
    keys = ["doc_id", "xh", *row]
    kinds = "doc_id long, xh long, " + "".join(f"{r} struct<file:long,at:long>, " for r in row)
    rows = stored(text.select(*keys, "text").mapInArrow(lean(_describe(width, keys)), kinds + "n long, digest binary, bands array<long>, sig binary"), "sketch")
    full = rows.filter("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", *row), F.lit(salts)).cast("int"))
    part = stored(full.groupBy("digest", "salt").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "xh")).alias("least")), "class")
    rep = part.groupBy("digest").agg(F.min("least").alias("least"))
    # a class is known by its least id; where one id leads several classes, the others get a number from their
    # digest, and so do classes that have no id
    first = rep.filter("least.doc_id is not null").groupBy(F.col("least.doc_id").alias("doc_id")).agg(F.min("digest").alias("owner"))
    rep = rep.join(first, F.col("least.doc_id") == F.col("doc_id"), "left")
    rep = stored(rep.select("digest", "doc_id", F.col("least.xh").alias("xh"), F.when(F.col("digest") == F.col("owner"), F.col("doc_id")).otherwise(F.xxhash64("digest")).alias("rep")), "rep")
    classes = rep.select("rep", "doc_id", "xh")
    named = rep.select(F.col("digest").alias("of"), F.col("doc_id").alias("lead"), F.col("xh").alias("lead_xh"), "rep")
    sketch = rows.join(named, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("lead")) & (F.col("xh") == F.col("lead_xh"))).dropDuplicates(["digest"])
    sketch = stored(sketch.select("rep", "n", "bands", "sig"), "reps")

    keys = sketch.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count(F.lit(1)).alias("members")).filter("hub < top")
    bucket = keys.join(shared.select("key", "hub", "members"), "key").join(sketch.select("rep", "n", "sig"), "rep")
    bucket = stored(bucket, "bucket")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    split = F.ceil(F.col("members") / DEALT).cast("int")
    salt = F.when(F.col("rep") == F.col("hub"), F.sequence(F.lit(0), split - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), split).cast("int")))
    met = bucket.select("key", F.explode(salt).alias("salt"), "rep", "n", "sig", (F.col("rep") != F.col("hub")).alias("later"), F.xxhash64("rep", "key").alias("turn"))
    first = met.repartition(tasks, "key", "salt").sortWithinPartitions("key", "salt", "later", "turn").mapInArrow(lean(_with_pivots(percent)), PAIR)
    once = first.groupBy(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).agg(F.min(F.struct("a", "b", "agree")).alias("p")).select("p.*")
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("agree"), "a"))
    once = stored(once.withColumn("k", best).filter("k <= 2").select("a", "b"), "first")

    texts = text.select("doc_id", "xh", "text")
    known = verified(once, classes, texts, width, percent, most_bits)
    label = components(known.filter("linked"))

    part_of = bucket.drop("sig").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    sizes = part_of.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("of"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("of", "comp")).alias("top"), F.sum("of").alias("all")).filter("top.of < all")
    live = part_of.join(largest, "key").withColumn("outside", F.col("comp") != F.col("top.comp"))
    live = stored(live.select("key", "rep", "n", "comp", "outside", F.ceil((F.col("all") - F.col("top.of")) / BLOCK).cast("int").alias("of_outside"), F.ceil(F.col("all") / BLOCK).cast("int").alias("of_all")), "open")
    ids = live.select("rep").distinct()
    fine = stored(texts_of(classes.join(ids, "rep", "left_semi"), texts, most_bits).mapInArrow(lean(_fine(width)), "rep long, fine binary"), "fine")
    # an outsider asks in its block of outsiders; every row is asked in its block of all rows
    here = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    upto = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    asks = live.filter("outside").select("*", F.lit(True).alias("asks"), here("of_outside").alias("i"), F.explode(upto("of_all")).alias("j"))
    asked = live.select("*", F.lit(False).alias("asks"), F.explode(upto("of_outside")).alias("i"), here("of_all").alias("j"))
    cells = asks.unionByName(asked).join(fine.join(sketch.select("rep", "bands"), "rep"), "rep").select("key", "i", "j", "rep", "n", "bands", "fine", "comp", "outside", "asks")
    rest = cells.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(_across(percent)), PAIR)
    tested = known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = stored(rest.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "rest")
    more = verified(rest, classes, texts, width, percent, most_bits).filter("linked").select("a", "b")
    label = components(known.filter("linked").select("a", "b").unionByName(more))

    # components are known by a node; their id is the least doc_id of their classes
    node = rep.select("digest", "doc_id", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = node.join(least, "component", "left").select("digest", "component", "component_id")
    salted = part.select("digest", "salt").join(whole, "digest")
    linked = full.join(salted, ["digest", "salt"]).select("doc_id", "n", "component", "component_id", *row)
    return rows.filter("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"), *row).unionByName(linked)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

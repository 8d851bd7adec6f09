"""Retrieval for batches of queries: BM25, exact cosine search and their fusion by reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import document, tokenize
from ..sources.shared import bucketed, spread, stored

#: BM25's saturation, length weight and floor share, and the constant of rank fusion.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60
#: Places to which scores are rounded before they are ranked, so that the order of sums can't show.
PLACES = 6
#: Name of the one scope of a search over everything.
WHOLE = "_whole"
#: Postings of a block, postings that a task inverts at a time, and terms of a query that a first bound is taken from.
POSTINGS, INVERTED, SEEDS = 128, 1 << 20, 6
#: Tokens that a task counts at a time.
COUNTED = 1 << 18
#: What a score may miss a bound by and still be rounded to it.
MARGIN = 1e-5
#: Query vectors a task multiplies at a time, numbers of a written block of vectors, and rings around a pivot.
QUERY_BLOCK, BLOCK_FLOATS, RINGS = 256, 1 << 16, 64


def search_documents(nodes: DataFrame) -> DataFrame:
    """(repo_id, node_id, path, start_line, text) of functions and classes."""
    rows = nodes.filter("type in ('function', 'class')")
    return rows.select("repo_id", F.col("id").alias("node_id"), "path", "start_line", document(F.col("qualified_name"), F.col("summary"), F.col("raw_source")).alias("text"))


def _pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with at most ``most`` items in a list column, or one row."""
    ends, a = batch.column(column).offsets.to_numpy().astype(np.int64), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's tokens as its distinct terms and how often each occurs, ``COUNTED`` tokens at a time."""
    for batch in (piece for whole in batches for piece in _pieces(whole, "tokens", COUNTED)):
        tokens = batch.column("tokens")
        coded = tokens.flatten().dictionary_encode()
        offsets = tokens.offsets.to_numpy().astype(np.int64)
        size, words = np.diff(offsets), max(1, len(coded.dictionary))
        pair, count = np.unique(np.repeat(np.arange(len(size)), size) * words + coded.indices.to_numpy(), return_counts=True)
        at = pa.array(np.searchsorted(pair, np.arange(len(size) + 1) * words).astype(np.int32))
        terms = pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(pair % words)))
        keep = [n for n in batch.schema.names if n != "tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(size.astype(np.int32)), terms, pa.ListArray.from_arrays(at, pa.array(count.astype(np.int32)))], [*keep, "dl", "terms", "counts"])


def token_index(documents: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, doc, node_id, path, start_line, dl, terms, counts): one written row a document, tokenised once."""
    rows = spread(documents).select(*scope, F.monotonically_increasing_id().alias("doc"), "node_id", "path", "start_line", tokenize(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"))
    kinds = [f for f in rows.schema.fields if f.name != "tokens"]
    kinds += [T.StructField("dl", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]
    return stored(rows.mapInArrow(_counted, T.StructType(kinds)), "tokens")


def _one_row(scope: list[str]):
    return F.broadcast if scope == [WHOLE] else lambda df: df


def _corpus(index: DataFrame, scope: list[str]) -> DataFrame:
    return stored(index.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), "corpus")


def _weights(df: DataFrame, corpus: DataFrame, scope: list[str]) -> DataFrame:
    """The terms (scope, term, df, ...) with their idf and the figures of their scope."""
    raw = stored(df.join(_one_row(scope)(corpus), scope).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "idf")
    mean = raw.groupBy(*scope).agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw"))
    return raw.join(_one_row(scope)(mean), scope).withColumn("idf", idf).drop("raw", "mean")


def bm25_stats(documents: DataFrame, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(corpus, terms): documents, mean length and floor of each scope; df and idf of each term. A negative
    idf becomes EPSILON times the mean idf of the vocabulary. Terms are counted in each document where it lies;
    only sums by term shuffle."""
    if not scope:
        corpus, terms = bm25_stats(documents.withColumn(WHOLE, F.lit(0)), [WHOLE])
        return corpus.drop(WHOLE), terms.drop(WHOLE)
    index = token_index(documents, scope)
    corpus = _corpus(index, scope)
    df = index.select(*scope, F.explode("terms").alias("term")).groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    return corpus, _weights(df, corpus, scope).select(*scope, "term", "df", "idf", "n", "avgdl")


def _part(f: Column, dl: Column, avgdl: Column) -> Column:
    """What a term that occurs ``f`` times adds to a document's score, before its weight; under K1 + 1."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def _inverted(scope: str, block: int):
    """Postings of the documents of a task, ``INVERTED`` at a time: blocks of at most ``block`` documents of one
    term, those it counts most in first, with the most it adds to any of them."""

    def invert(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        terms, counts = batch.column("terms"), batch.column("counts")
        size = np.diff(terms.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        f, dl, mean = counts.flatten().to_numpy().astype(np.float64), batch.column("dl").to_numpy()[row], batch.column("avgdl").to_numpy()[row]
        part = f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))
        named, within = terms.flatten().dictionary_encode(), batch.column(scope).dictionary_encode()
        code = within.indices.to_numpy()[row].astype(np.int64) * max(1, len(named.dictionary)) + named.indices.to_numpy()
        order = np.lexsort((-part, code))
        code, part, doc = code[order], part[order], batch.column("doc").to_numpy()[row][order]
        first = np.append(True, code[1:] != code[:-1])
        start = np.flatnonzero(first)[np.cumsum(first) - 1] if len(code) else np.empty(0, np.int64)
        at = np.flatnonzero((np.arange(len(code)) - start) % block == 0)
        cuts = pa.array(np.append(at, len(code)).astype(np.int32))
        names = pa.array(code[at] % max(1, len(named.dictionary))), pa.array(code[at] // max(1, len(named.dictionary)))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (doc, part)]
        return pa.RecordBatch.from_arrays([within.dictionary.take(names[1]), named.dictionary.take(names[0]), pa.array(part[at]), *lists], [scope, "term", "most", "docs", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in (piece for whole in batches for piece in _pieces(whole, "terms", INVERTED // 4)):
            held.append(batch)
            n += len(batch.column("terms").flatten())
            if n >= INVERTED:
                yield invert(held)
                held, n = [], 0
        if n:
            yield invert(held)

    return run


def postings(index: DataFrame, corpus: DataFrame, scope: str, block: int = POSTINGS) -> DataFrame:
    """(scope, term, most, docs, parts, at): a written table of blocks of postings, sorted by term. A term of any
    share of the documents is as many blocks as it needs, and each has its own upper bound."""
    rows = index.join(_one_row([scope])(corpus), scope).select(scope, "doc", "dl", "avgdl", "terms", "counts")
    kind = dict(rows.dtypes)[scope]
    made = rows.mapInArrow(_inverted(scope, block), f"`{scope}` {kind}, term string, most double, docs array<long>, parts array<double>")
    return stored(made.repartitionByRange(scope, "term", "most").sortWithinPartitions(scope, "term").withColumn("at", F.monotonically_increasing_id()), "postings")


def _hits(terms: DataFrame, blocks: DataFrame, scope: str) -> DataFrame:
    """(query_id, doc, partial): sums over the terms (scope, query_id, term, weight) and blocks that meet."""
    met = terms.join(blocks, [scope, "term"]).select("query_id", "weight", F.explode(F.arrays_zip("docs", "parts")).alias("p"))
    return met.groupBy("query_id", F.col("p.docs").alias("doc")).agg(F.sum(F.col("weight") * F.col("p.parts")).alias("partial"))


def _kth(hits: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """(query_id, bound): a score that k documents of the query reach at least, where it is above 0."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("partial")))
    kth = hits.withColumn("place", place).filter(F.col("place") <= k).filter(F.col("place") == k)
    return kth.join(low, "query_id").select("query_id", (F.col("partial") + F.col("low")).alias("bound")).filter("bound > 0")


def candidates(asked: DataFrame, blocks: DataFrame, scope: str, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, doc, partial, rest, full), (scope, query_id, term, weight, open)): the documents that can be among a
    query's k best with what its essential terms add and the most that the others can, whose part is open; all of
    a query's terms, the open ones marked.

    The best blocks of a few terms give k documents' least scores, so a bound. The terms that together can't
    reach it need no postings of their own; of the others' blocks those are read whose most, with all that the
    query's other terms can add, reaches it. What these add raises the bound once more. A query without a
    bound (fewer than k good matches) has no open terms, and all its matches are candidates."""
    whole = Window.partitionBy("query_id")
    gain, loss = F.greatest(F.col("weight") * F.col("top"), F.lit(0.0)), F.least(F.col("weight"), F.lit(0.0)) * (K1 + 1)
    asked = stored(asked.withColumn("gain", gain).withColumn("all", F.sum("gain").over(whole)).withColumn("low", F.sum(loss).over(whole)), "weighed")
    low = asked.select("query_id", "low").distinct()
    best = F.row_number().over(whole.orderBy(F.desc("gain"), "term"))
    common = F.row_number().over(whole.orderBy(F.desc("df"), "term"))
    seeds = asked.filter("weight > 0").withColumn("best", best).withColumn("common", common).filter((F.col("best") <= SEEDS) | (F.col("common") == 1))
    lead = blocks.join(seeds.select(scope, "term").distinct(), [scope, "term"], "left_semi").groupBy(scope, "term").agg(F.max(F.struct("most", "at", "docs", "parts")).alias("b")).select(scope, "term", "b.docs", "b.parts")
    bound = stored(_kth(_hits(seeds.select(scope, "query_id", "term", "weight"), lead, scope), low, k), "bound")

    upto = F.sum("gain").over(whole.orderBy("gain", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parted = asked.join(bound, "query_id", "left").withColumn("upto", upto).withColumn("open", F.coalesce(F.col("upto") < F.col("bound") - MARGIN, F.lit(False)))
    parted = stored(parted, "parted")
    reach = F.col("bound").isNull() | (F.col("weight") * F.col("most") + F.col("all") - F.col("gain") >= F.col("bound") - MARGIN)
    essential = parted.filter("NOT open").join(blocks, [scope, "term"]).filter(reach)
    hits = essential.select("query_id", "weight", F.explode(F.arrays_zip("docs", "parts")).alias("p")).groupBy("query_id", F.col("p.docs").alias("doc")).agg(F.sum(F.col("weight") * F.col("p.parts")).alias("partial"))
    hits = stored(hits, "hits")
    more = bound.join(_kth(hits, low, k).withColumnRenamed("bound", "raised"), "query_id", "left").select("query_id", F.greatest("bound", "raised").alias("bound"))
    rest = parted.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("open"), F.col("upto"))), F.lit(0.0)).alias("rest"))
    kept = hits.join(rest, "query_id").join(more, "query_id", "left").filter(F.col("bound").isNull() | (F.col("partial") + F.col("rest") >= F.col("bound") - MARGIN))
    full = kept.select("query_id", "doc", "partial", "rest", F.col("bound").isNull().alias("full"))
    return stored(full, "candidates"), parted.select(scope, "query_id", "term", "weight", "open")


def bm25_search(documents: DataFrame, queries: DataFrame, k: int = 10, scope: list[str] | None = None) -> DataFrame:
    """(query_id, node_id, score, rank from 1) of the k best documents of each query (query_id, text, and the
    scope's column). Documents without a match score 0 and fill up to k in corpus order (path, start line,
    id); floored terms can bring matches below them. Empty queries and k < 1 give nothing. A query_id stands in
    one scope.

    Documents are tokenised once and inverted where they lie; postings are a written table of blocks with upper
    bounds. Queries are a table too: they meet postings by term, and only ``candidates`` are scored in full."""
    spark = documents.sparkSession
    if not scope:
        return bm25_search(documents.withColumn(WHOLE, F.lit(0)), queries.withColumn(WHOLE, F.lit(0)), k, [WHOLE])
    (name,) = scope
    if k < 1:
        return spark.createDataFrame([], "query_id long, node_id string, score double, rank int")
    index = token_index(documents, scope)
    corpus = _corpus(index, scope)
    blocks = postings(index, corpus, name, max(POSTINGS, k))
    df = blocks.groupBy(name, "term").agg(F.sum(F.size("docs")).alias("df"), F.max("most").alias("top"))
    asked = queries.select(name, "query_id", F.explode(tokenize(F.col("text"))).alias("term")).filter(F.col(name).isNotNull()).groupBy(name, "query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    asked = stored(asked, "asked")
    terms = _weights(df, corpus, scope).join(asked.select(name, "term").distinct(), [name, "term"], "left_semi")
    known = asked.join(terms.select(name, "term", "df", "top", "idf"), [name, "term"]).withColumn("weight", F.col("qf") * F.col("idf"))
    own_blocks = stored(blocks.join(asked.select(name, "term").distinct(), [name, "term"], "left_semi"), "asked-postings")
    found, parted = candidates(known.select(name, "query_id", "term", "weight", "df", "top"), own_blocks, name, k)

    # what the open terms add is read from the candidates' own documents: first of those that have most already,
    # whose full scores raise the bound, then of those that can still reach it
    lacking = parted.filter("open").select("query_id", "term", "weight")
    near = index.join(found.select("doc").distinct(), "doc", "left_semi").join(_one_row(scope)(corpus), scope)
    own = near.select("doc", "dl", "avgdl", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("doc", F.col("t.terms").alias("term"), _part(F.col("t.counts"), F.col("dl"), F.col("avgdl")).alias("part"))
    own = stored(own.join(lacking.select("term").distinct(), "term", "left_semi"), "open-parts")

    def full(some: DataFrame) -> DataFrame:
        added = some.join(lacking, "query_id").join(own, ["doc", "term"]).groupBy("query_id", "doc").agg(F.sum(F.col("weight") * F.col("part")).alias("added"))
        return some.join(added, ["query_id", "doc"], "left").withColumn("score", F.col("partial") + F.coalesce("added", F.lit(0.0)))

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("partial")))
    ahead = full(found.filter("NOT full").withColumn("place", place).filter(F.col("place") <= 2 * k).drop("place"))
    reached = ahead.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.get("s", F.lit(k - 1)).alias("reached"))
    left = found.join(stored(reached, "reached"), "query_id", "left").filter(F.col("reached").isNull() | (F.col("partial") + F.col("rest") >= F.col("reached") - MARGIN))
    places = index.select("doc", "node_id", "path", "start_line")
    scored = full(stored(left.select("query_id", "doc", "partial"), "left")).join(places, "doc")
    scored = scored.select("query_id", "node_id", "path", "start_line", (F.round("score", PLACES) + 0.0).alias("score"))

    # queries without a bound: the first documents of their scope that they don't match
    bound = found.filter("NOT full").select("query_id").distinct()
    short = asked.select(name, "query_id").distinct().join(bound, "query_id", "left_anti")
    matches = found.filter("full").groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    most = short.join(matches, "query_id", "left").groupBy(name).agg((F.coalesce(F.max("m"), F.lit(0)) + k).alias("head"))
    order = F.row_number().over(Window.partitionBy(name).orderBy("path", "start_line", "node_id", "doc"))
    head = index.join(F.broadcast(most), name).select(name, "doc", "node_id", "path", "start_line", "head").withColumn("place", order).filter(F.col("place") <= F.col("head"))
    fill = short.join(head, name).join(found.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    out = scored.unionByName(fill.select("query_id", "node_id", "path", "start_line", F.lit(0.0).alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line", "node_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")


@dataclass
class VectorIndex:
    """Vectors in written blocks. A block's vectors lie in one ring around one pivot; all blocks of a ring share its
    least and largest angle to the pivot. ``groups`` has a column a ring: its number, those two angles, its rows and
    its blocks. It is bounded by pivots and rings, whatever the number of vectors."""

    blocks: DataFrame
    pivots: np.ndarray
    groups: np.ndarray


def _matrix(vectors: pa.Array, rows: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _angles(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The angle of each vector to each pivot, and the vectors' lengths."""
    size = np.linalg.norm(m, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.arccos(np.clip(m / size[:, None] @ pivots.T, -1, 1)), size


def _dealt(pivots: np.ndarray):
    """Adds the ring of each vector and its angle to the ring's pivot. Zero vectors have a ring of their own, and so
    have those without a finite length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle, size = _angles(_matrix(batch.column("embedding"), batch.num_rows), pivots)
                odd = ~np.isfinite(size) | (size == 0)
                cell = np.where(odd, 0, angle.argmin(axis=1))
                near = np.where(odd, 0.0, angle[np.arange(len(cell)), cell])
                ring = cell * RINGS + np.minimum((near * RINGS / np.pi).astype(np.int64), RINGS - 1)
                ring = np.where(odd, len(pivots) * RINGS + (size != 0), ring)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring.astype(np.int32)), pa.array(near)], ["node_id", "embedding", "ring", "angle"])

    return run


def vector_index(embeddings: DataFrame, pivots: int = 128) -> VectorIndex | None:
    """Blocks of about ``BLOCK_FLOATS`` numbers; None without a vector. Pivots are ``pivots`` vectors, the first by
    the hash of their ids: a bounded sample that only says how well blocks are told apart. Every vector is in a block,
    and a ring of any size is dealt to as many blocks as it fills. Null and empty vectors are left out; all others
    have one length."""
    spark = embeddings.sparkSession
    rows = embeddings.filter("size(embedding) > 0").select(F.col("node_id").cast("string").alias("node_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = np.array([r.embedding for r in rows.orderBy(F.xxhash64("node_id")).limit(pivots).collect()], np.float64)
    if not len(sample):
        return None
    size = np.linalg.norm(sample, axis=1)
    good = np.isfinite(size) & (size > 0)
    center = np.unique(sample[good] / size[good, None], axis=0) if good.any() else np.eye(1, sample.shape[1])
    dealt = stored(rows.mapInArrow(_dealt(center), "node_id string, embedding array<double>, ring int, angle double"), "rings")
    each = max(1, BLOCK_FLOATS // sample.shape[1])
    found = dealt.groupBy("ring").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1)).alias("n")).collect()
    groups = np.array(sorted((*r, -(-r.n // each)) for r in found), np.float64).T
    parts = spark.createDataFrame([(int(g), int(n)) for g, n in zip(groups[0], groups[4])], "ring int, parts long")
    block = _block(F.col("ring"), F.pmod(F.monotonically_increasing_id(), F.col("parts")))
    flat = dealt.join(F.broadcast(parts), "ring").select(block.alias("block"), "node_id", "embedding")
    fold = lambda df: df.groupBy("block").agg(F.collect_list(F.struct("node_id", "embedding")).alias("v")).select("block", F.col("v.node_id").alias("ids"), F.flatten("v.embedding").alias("vectors"))
    return VectorIndex(bucketed(flat, "vectors", ["block"], fold), center, groups)


def _block(ring: Column, part: Column) -> Column:
    return F.shiftleft(ring.cast("long"), 32) + part


def _opened(index: VectorIndex, k: int, again: bool):
    """The rings that queries open, some queries a row. First those with the least bounds that have ``k`` vectors
    together; ``again``, of the others, those whose bound can reach the distance ``reached``."""
    low, high, rows, parts = index.groups[1:]
    ring, pivots = index.groups[0].astype(np.int64), index.pivots
    of = np.minimum(ring // RINGS, len(pivots) - 1)
    zero, endless = ring == len(pivots) * RINGS, ring == len(pivots) * RINGS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(a, QUERY_BLOCK)
                m = _matrix(batch.column("embedding"), batch.num_rows)
                angle = _angles(m, pivots)[0][:, of]
                bound = 1 - np.cos(np.maximum(np.maximum(low - angle, angle - high), 0))
                bound = np.where(zero, np.inf, np.where(endless | np.isnan(bound), -np.inf, bound))
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(rows[order], axis=1) - rows[order]
                opens = np.zeros(bound.shape, bool)
                np.put_along_axis(opens, order, before < k, axis=1)
                if again:
                    reached = batch.column("reached").to_numpy(zero_copy_only=False).astype(np.float64)
                    opens = ~opens & (np.isnan(reached)[:, None] | (bound <= reached[:, None] + MARGIN))
                for g in np.flatnonzero(opens.any(axis=0)):
                    at = np.flatnonzero(opens[:, g])
                    asks = batch.column("query_id").take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ring[g]], pa.int32()), pa.array([int(parts[g])], pa.int64()), pa.ListArray.from_arrays([0, len(at)], asks), pa.array([m[at].ravel()], pa.list_(pa.float64()))],
                        ["ring", "parts", "asks", "asked"],
                    )

    return run


def openings(index: VectorIndex, asked: DataFrame, k: int, again: bool = False) -> DataFrame:
    """(block, asks, asked): the queries that open each block, at most ``QUERY_BLOCK`` a row, and their vectors."""
    rings = asked.mapInArrow(_opened(index, k, again), "ring int, parts long, asks array<long>, asked array<double>")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    return rings.select("ring", part, "asks", "asked").select(_block(F.col("ring"), F.col("part")).alias("block"), "asks", "asked")


def _nearest(k: int):
    """The k nearest vectors of one block for each query that opens it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, asks = batch.column("ids")[i].values, batch.column("asks")[i].values
                m = batch.column("vectors")[i].values.to_numpy(zero_copy_only=False).reshape(len(names), -1)
                q = batch.column("asked")[i].values.to_numpy(zero_copy_only=False).reshape(len(asks), -1)
                size, norm, take = np.linalg.norm(m, axis=1), np.linalg.norm(q, axis=1), min(k, len(m))
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    distance = np.round(1 - (q @ m.T) / (norm[:, None] * size[None]), PLACES) + 0.0
                key = np.where(np.isnan(distance), np.inf, distance)
                edge = np.partition(key, take - 1, axis=1)[:, take - 1]
                of, at, value = [], [], []
                for j in range(len(key)):
                    near = np.flatnonzero(key[j] <= edge[j])
                    if len(near) > take:  # ties at the edge go by id
                        near = near[np.lexsort((names.take(pa.array(near)).to_numpy(zero_copy_only=False).astype(object), key[j][near]))[:take]]
                    of.append(np.full(take, j))
                    at.append(near)
                    value.append(key[j][near])
                value = np.concatenate(value)
                yield pa.RecordBatch.from_arrays(
                    [asks.take(pa.array(np.concatenate(of))), names.take(pa.array(np.concatenate(at))), pa.array(value, pa.float64(), mask=value == np.inf)],
                    ["query_id", "node_id", "distance"],
                )

    return run


def search_index(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """``vector_search`` over a written index, which serves any number of query tables.

    A query first opens the blocks of the rings nearest by their bounds, enough to hold k vectors. The k-th distance
    found there bounds the rest: an angle in a ring differs from the query's angle to its pivot by at least what
    that lies outside the ring, so rings that can't come as near as the k-th are never opened. Without a k-th
    distance all are. Queries are a table, and blocks stay in their buckets: only the queries that open them move."""
    asked = queries.filter("size(embedding) > 0").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def search(opened: DataFrame) -> DataFrame:
        return opened.join(index.blocks, "block").mapInArrow(_nearest(k), "query_id long, node_id string, distance double")

    order = [F.col("distance").asc_nulls_last(), F.col("node_id")]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    first = stored(search(openings(index, asked, k)).withColumn("r", place).filter(F.col("r") <= k), "nearest")
    reached = first.filter(F.col("r") == k).select("query_id", F.col("distance").alias("reached"))
    more = search(openings(index, asked.join(reached, "query_id", "left"), k, again=True))
    best = first.drop("r").unionByName(more).withColumn("r", place).filter(F.col("r") <= k)
    once = best.groupBy("query_id", "node_id").agg(F.min("r").alias("r"), F.min("distance").alias("distance"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).select("query_id", "node_id", "distance", "rank")


def vector_search(embeddings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, node_id, distance, rank from 1): exact cosine search of every query against all rows, first k
    rows of each, then one per node; ties by id. Null and empty vectors are left out; zero vectors have no distance
    and come last. Empty queries and k < 1 give nothing."""
    index = vector_index(embeddings) if k >= 1 else None
    if index is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, node_id string, distance double, rank int")
    return search_index(index, queries, k)


def rrf_fuse(lists: list[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """(query_id, node_id, score, rank): sum over the lists (query_id, node_id, rank from 1) of
    1 / (constant + rank - 1); ties by first appearance, earlier lists first."""
    rows = None
    for n, one in enumerate(lists):
        part = one.select("query_id", "node_id", F.lit(n).alias("list"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "node_id").agg(F.round(F.sum(1 / (constant + F.col("rank") - 1)), 12).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "node_id"))
    return fused.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")


def hybrid_search(documents: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Both searches at the same k, fused."""
    return rrf_fuse([bm25_search(documents, queries, k), vector_search(embeddings, queries, k)], k)


def label_results(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds qualified_name and type; unknown ids keep nulls. Only nodes that were found are grouped."""
    results = stored(results, "results")
    near = nodes.select(F.col("id").alias("node_id"), "repo_id", "qualified_name", "type").join(results.select("node_id").distinct(), "node_id", "left_semi")
    names = near.groupBy("node_id").agg(F.min_by("qualified_name", "repo_id").alias("qualified_name"), F.min_by("type", "repo_id").alias("type"))
    return results.join(names, "node_id", "left")

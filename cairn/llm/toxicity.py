"""Toxicity (operator 2): a support vector machine over a gap-weighted subsequence string kernel with
Nystroem landmarks. It scores words, so gapped and padded spellings stay near the plain ones; a text's
score comes from its two most insulting places."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import give_back, read_table, slices, text_or_empty, words_of

#: Letters of a subsequence, decay a place, widest stretch, and letters of one unit.
ORDER, DECAY, SPAN, UNIT = 3, 0.7, 6, 16
CODES = 32
#: Bytes of text that a task scores at a time; its words and pairs take some twenty times as much.
SLICE = 4 << 20
GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
FLOOR = -3.0


def _code_table() -> np.ndarray:
    """Code of each character: letters by their base letter, digits one code, other letters hashed, and 0
    for the rest, which takes no place."""
    import unicodedata

    table = np.zeros(0x3000, np.uint8)
    for cp in range(0x3000):
        base = unicodedata.normalize("NFD", chr(cp))[0].lower()
        if "a" <= base <= "z":
            table[cp] = ord(base) - 96
        elif chr(cp).isdigit():
            table[cp] = 27
        elif chr(cp).isalpha():
            table[cp] = 28 + cp % 4
    return table


_CODE = _code_table()


def letters_of(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters of lower-case words, one after another, and how many each word has: marks take
    no place, so any number of them between two letters leaves the gap as it is."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    cp = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(cp < len(_CODE), _CODE[np.minimum(cp, len(_CODE) - 1)], 28 + cp % 4).astype(np.uint8)
    before, end = np.append(0, np.cumsum(code > 0)), np.cumsum(size)
    return code[code > 0], before[end] - before[end - size]


def unit_matrix(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of the units of lower-case words (rows of UNIT, zero at the end), and the word of
    each. A longer word is cut to overlapping units, so all of it counts."""
    code, size = letters_of(words)
    begin = np.cumsum(size) - size
    parts = np.maximum(1, -(-(size - UNIT) // (UNIT // 2)) + 1)
    word = np.repeat(np.arange(len(size)), parts)
    turn = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    first, left = begin[word] + turn * (UNIT // 2), size[word] - turn * (UNIT // 2)
    place = np.arange(UNIT)[None]
    code = np.append(code, np.zeros(UNIT, np.uint8))
    return np.where(place < left[:, None], code[np.minimum(first[:, None] + place, len(code) - 1)], 0).astype(np.uint8), word


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(keys, weight) of all gapped subsequences: key 0 stands where a place has no letter."""
    c = codes.astype(np.int32)
    for i, j in GAPS:
        x, y, z = c[:, : UNIT - j], c[:, i : UNIT - j + i], c[:, j:]
        key = (x * CODES + y) * CODES + z
        key[(x == 0) | (y == 0) | (z == 0)] = 0
        yield key, DECAY ** (j + 1)


def scale(codes: np.ndarray) -> np.ndarray:
    """The kernel's normaliser of each unit; 0 for units without a subsequence."""
    total = sum(w * w * (key > 0).sum(axis=1) for key, w in subsequences(codes))
    return np.where(total > 0, 1 / np.sqrt(np.maximum(total, 1e-12)), 0.0)


def project(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Normalised sum of a per-subsequence table over each unit. A unit's letters stand at its front, so a
    subsequence is full if its last place has a letter."""
    table = table.copy()
    table[::CODES] = 0
    size = (codes > 0).sum(axis=1)
    squares = sum(DECAY ** (2 * (j + 1)) * np.maximum(size - j, 0) for _, j in GAPS)
    out = np.zeros(len(codes))
    for low, width in ((2, 5), (5, 8), (8, 11), (11, UNIT)):
        at = np.flatnonzero((size > low) & (size <= width))
        for a in range(0, len(at), 1 << 13):
            rows = at[a : a + (1 << 13)]
            c = codes[rows, :width].astype(np.int32)
            x, y, total = c * (CODES * CODES), c * CODES, np.zeros(len(rows))
            for i, j in GAPS:
                if j < width:
                    total += DECAY ** (j + 1) * table.take(x[:, : width - j] + y[:, i : width - j + i] + c[:, j:]).sum(axis=1)
            out[rows] = total
    return np.where(squares > 0, out / np.sqrt(np.maximum(squares, 1e-12)), 0.0)


@dataclass
class Model:
    """The machine's weight of each subsequence, its offset, and the logistic curve of a text's two best units."""

    table: np.ndarray
    offset: float
    curve: np.ndarray

    def units(self, words: pa.StringArray) -> np.ndarray:
        """Margin of each word: that of its best unit."""
        out = [np.zeros(0)]
        for a in range(0, len(words), 1 << 16):
            codes, word = unit_matrix(words.slice(a, 1 << 16))
            out.append(np.maximum.reduceat(project(codes, self.table) + self.offset, np.flatnonzero(np.diff(word, prepend=-1))))
        return np.concatenate(out)

    def margins(self, texts: pa.StringArray) -> np.ndarray:
        flat, offsets = words_of(pc.utf8_lower(texts))
        if not len(flat):
            return top_two(np.zeros(0), offsets, ([], []), self)
        coded = flat.dictionary_encode()
        margin = self.units(coded.dictionary)[coded.indices.to_numpy()]
        first, second, pairs, which, _ = neighbours(coded, offsets)
        value = self.units(pairs)[which]
        # a pair counts at its first word, where it says more than either word
        better = value > np.maximum(margin[first], margin[second])
        margin[first[better]] = value[better]
        return top_two(margin, offsets, spelled(coded, offsets), self)

    def score(self, best: np.ndarray) -> np.ndarray:
        z = best @ self.curve[:2] + self.curve[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lettered(coded: pa.DictionaryArray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words that have letters, how many each has, and their texts' numbers."""
    size = letters_of(coded.dictionary)[1][coded.indices.to_numpy()]
    at = np.flatnonzero(size)
    return at, size[at], np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[at]


def neighbours(coded: pa.DictionaryArray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.StringArray, np.ndarray, np.ndarray]:
    """Neighbouring words that fit one unit together (words broken by a space, insults of two words): places
    of the first and the second, the distinct pairs joined, each place's pair, and the pairs' two words."""
    at, size, of = lettered(coded, offsets)
    both = size[:-1] + size[1:]
    fit = np.flatnonzero((of[:-1] == of[1:]) & (both >= ORDER) & (both <= UNIT))
    first, second = at[fit], at[fit + 1]
    del at, size, of, both, fit
    index, n = coded.indices.to_numpy(), np.int64(len(coded.dictionary))
    pair, which = np.unique(index[first] * n + index[second], return_inverse=True)
    parts = np.stack((pair // n, pair % n))
    return first, second, pc.binary_join_element_wise(*(coded.dictionary.take(pa.array(p)) for p in parts), ""), which, parts


def spelled(coded: pa.DictionaryArray, offsets: np.ndarray) -> tuple[list[str], list[int]]:
    """Words spelled out in single letters (three or more in a row, marks between them or not), joined, and
    their text's number."""
    at, size, of = lettered(coded, offsets)
    one = size == 1
    cut = np.append(True, (one[1:] != one[:-1]) | (of[1:] != of[:-1]))[: len(one)]
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(one))
    runs = np.flatnonzero(one[starts] & (ends - starts >= 3)) if len(one) else []
    index = coded.indices.to_numpy()
    words = ["".join(coded.dictionary.take(pa.array(index[at[starts[r] : ends[r]]])).to_pylist()) for r in runs]
    return words, [int(of[starts[r]]) for r in runs]


def top_two(margin: np.ndarray, offsets: np.ndarray, runs: tuple[list[str], list[int]], model: Model) -> np.ndarray:
    """The two largest margins of each text, FLOOR where it has fewer words."""
    n = len(offsets) - 1
    out = np.full((n, 2), FLOOR)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        m, starts = margin.copy(), offsets[full]
        for k in range(2):
            best = np.maximum.reduceat(m, starts)
            out[full, k] = np.maximum(best, FLOOR)
            at = np.where(m == np.repeat(best, np.diff(np.append(starts, len(m)))), np.arange(len(m)), len(m))
            m[np.minimum.reduceat(at, starts)] = FLOOR
    if runs[0]:
        for value, text in zip(model.units(pa.array(runs[0])), runs[1]):
            out[text] = np.sort([*out[text], value])[:0:-1]
    return out


def fit(texts: list[str], toxic: np.ndarray, prior: float, landmarks: int = 256, rounds: int = 3, seed: int = 7) -> Model:
    """Fit on labelled texts: pick each toxic text's witness (a word, or a pair of words that three toxic
    texts have), train against words and pairs of clean texts, pick again. Without texts of both kinds every score is the prior."""
    flat_curve = np.array([0.0, 0.0, np.log(max(prior, 1e-6) / (1 - min(prior, 1 - 1e-6)))])
    none = Model(np.zeros(CODES**3), 0.0, flat_curve)
    flat, offsets = words_of(pc.utf8_lower(pa.array(texts, pa.string())))
    if not len(flat) or toxic.all() or not toxic.any():
        return none
    coded = flat.dictionary_encode()
    index, words = coded.indices.to_numpy(), coded.dictionary
    of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    pair = np.unique(of * np.int64(len(words)) + index)
    doc, word = (pair // len(words)).astype(np.int32), (pair % len(words)).astype(np.int32)
    del flat, pair
    df = np.stack([np.bincount(word[toxic[doc] == k], minlength=len(words)) for k in (False, True)])
    codes, owner = unit_matrix(words)
    count = np.zeros((2, CODES**3))
    for key, w in subsequences(codes):
        for k in (0, 1):
            count[k] += np.bincount(key.ravel(), weights=np.repeat(w * df[k][owner], key.shape[1]), minlength=CODES**3)
    # how much more a subsequence stands in toxic texts ranks the first witnesses
    contrast = np.log(count[1] / toxic.sum() + 1 / toxic.sum()) - np.log(count[0] / (~toxic).sum() + 1 / toxic.sum())
    contrast[0] = 0
    single = len(words)
    first, _, pairs, which, parts = neighbours(coded, offsets)
    found = np.unique(of[first] * np.int64(max(1, len(pairs))) + which)
    del first, which, coded, index, of
    doc, word = np.append(doc, (found // max(1, len(pairs))).astype(np.int32)), np.append(word, (found % max(1, len(pairs)) + single).astype(np.int32))
    del found
    order = np.argsort(doc, kind="stable")
    doc, word = doc[order], word[order]
    del order
    words = pa.concat_arrays([words, pairs])
    df = np.stack([np.bincount(word[toxic[doc] == k], minlength=len(words)) for k in (False, True)])
    rare = toxic[doc] & (word >= single) & (df[1][word] < 3)
    rng = np.random.default_rng(seed)
    model = Model(contrast, 0.0, flat_curve)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    for _ in range(rounds):
        value = model.units(words)
        value[single:][value[single:] <= np.maximum(*value[:single][parts])] = -np.inf
        value = np.where(rare, -np.inf, value[word])
        best = np.maximum.reduceat(value, starts)
        top = np.flatnonzero(value == np.repeat(best, np.diff(np.append(starts, len(value)))))
        at = top[np.searchsorted(top, starts)]
        del value
        witness, n_of = np.unique(word[at][toxic[doc[at]]], return_counts=True)
        keep = (n_of * 4 > df[0][witness])
        witness, n_of = witness[keep], n_of[keep]
        hard = np.unique(word[at][~toxic[doc[at]]])
        clean = np.flatnonzero(df[0][:single] > 0)
        negative = np.setdiff1d(np.union1d(hard, rng.choice(clean, min(len(clean), 4000), replace=False)), witness)
        if not len(witness) or not len(negative):
            return none
        ranked = witness[np.argsort(-n_of, kind="stable")][: landmarks * 3 // 4]
        chosen = np.concatenate((ranked, rng.choice(negative, min(len(negative), landmarks - len(ranked)), replace=False)))
        model = _machine(words, witness, n_of, negative, chosen, flat_curve)
    del words, pairs, parts, doc, word, rare
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    best = np.concatenate([model.margins(part.column("text")) for part in slices(iter([batch]), "text", 1 << 20)])
    return Model(model.table, model.offset, _curve(best, toxic, prior))


def _machine(words: pa.StringArray, positive: np.ndarray, weight: np.ndarray, negative: np.ndarray, chosen: np.ndarray, curve: np.ndarray) -> Model:
    """Squared-hinge linear machine on Nystroem features, folded to one weight a subsequence."""
    marks, _ = unit_matrix(words.take(pa.array(chosen)))
    norm = scale(marks)
    basis = np.zeros((len(marks), CODES**3), np.float32)
    for key, w in subsequences(marks):
        np.add.at(basis, (np.repeat(np.arange(len(marks)), key.shape[1]), key.ravel()), w * np.repeat(norm, key.shape[1]))
    basis[:, 0] = 0
    used = np.flatnonzero(basis.any(axis=0))
    basis = basis[:, used].astype(np.float64)
    value, vector = np.linalg.eigh(basis @ basis.T)
    good = value > 1e-4 * value.max()
    root = vector[:, good] / np.sqrt(value[good])

    def features(at: np.ndarray) -> np.ndarray:
        codes, owner = unit_matrix(words.take(pa.array(at)))
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = np.zeros((len(first), CODES**3), np.float32)
        for key, w in subsequences(codes[first]):
            np.add.at(rows, (np.repeat(np.arange(len(first)), key.shape[1]), key.ravel()), w)
        return (rows[:, used] @ basis.T) * scale(codes[first])[:, None] @ root

    x = np.concatenate([features(at[a : a + 200]) for at in (positive, negative) for a in range(0, len(at), 200)])
    y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
    cost = np.concatenate((weight / weight.sum(), np.full(len(negative), 1 / len(negative)))) * len(y) / 2
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, 1.0), 1e-3)
    for _ in range(25):  # Newton steps: the active set settles quickly
        live = y * (x @ w) < 1
        xa, ca = x[live], cost[live]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(ridge), (xa * ca[:, None]).T @ y[live])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    table = np.zeros(CODES**3)
    table[used] = (root @ w[:-1]) @ basis
    return Model(table, float(w[-1]), curve)


def _curve(best: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """Logistic regression of the label on a text's two best margins, moved to the true share of toxic texts."""
    x, y, w = np.hstack((best, np.ones((len(best), 1)))), toxic.astype(float), np.zeros(3)
    ridge = np.diag([1e-1, 1e-1, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    share = y.mean()
    w[2] += np.log(prior / (1 - prior)) - np.log(share / (1 - share)) if 0 < prior < 1 else 0
    return w


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_toxic: int = 1500, train_clean: int = 2500, train_chars: int = 20_000) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold: at most ``train_toxic`` toxic
    and ``train_clean`` clean texts, of at most ``train_chars`` characters each."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, bad = known.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    text = docs.filter("doc_id is not null").select("doc_id", text_or_empty(F.col("text")).alias("text")).filter(F.length("text") <= train_chars)
    sample = None
    for label, most in ((1, train_toxic), (0, train_clean)):
        # ids of half as many again as asked for, since some have no text short enough
        ids = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most * 3 // 2)
        sample = ids if sample is None else sample.unionByName(ids)
    rows = text.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit((train_toxic + train_clean) * 2).collect()
    rows = [r for k, most in ((1, train_toxic), (0, train_clean)) for r in [r for r in rows if r.toxic == k][:most]]
    model = fit([r.text for r in rows], np.array([bool(r.toxic) for r in rows], bool), (bad or 0) / n if n else 0.0)
    give_back()
    return model


def score_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of each text, in slices of a bounded size."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], ["text"])
            scores = [held.value.score(held.value.margins(part.column("text"))) for part in slices(iter([batch]), "text", SLICE)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))
        give_back()

    return run(text_or_empty(text))


def toxicity(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``least`` on).

    Null and empty texts have no word and get the score of two floor margins. Long texts count whole.
    Null ids are outside the held-out fold; repeated rows get one score each; other columns aren't
    carried and an empty table gives an empty one."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score_of(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def without_toxic(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows scored under ``least``, with their columns as they were."""
    names = docs.columns
    fresh = "score" + "_" * max([0, *(len(n) for n in names)])
    return docs.withColumn(fresh, score_of(docs.sparkSession, model, F.col("text"))).filter(F.col(fresh) < least).select(*[f"`{n}`" for n in names])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))

"""Cross-tokenizer alignment (operator 11): the tokens of two tokenizers over the same bytes, the groups between
their common ends, and how often over the corpus each pair of ids is linked."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spill_count
from ._work import lean, read_table, slices, stored
from .bpe import BYTE_LETTERS, load

#: A space after other white space, or at the end, may belong to a token that began before it.
_TANGLED = re.compile(r"\s(?: |$)")
_EDGE = re.compile(r"(?<=\S) (?= *[^ ])")
#: Letters that every edition of Unicode classes alike, and ASCII.
_PLAIN = re.compile("[\x00-~À-ÖØ-öø-įı-ɏ]*")
#: How the byte-level tokenizer cuts a text before merging.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text of a chunk, radixes of pair keys, pairs of a group beyond which its distinct ids are paired.
CHUNK, RADIXES, WIDE = 4 << 20, 64, 64
_ALIGNERS: dict[tuple, Aligner] = {}


def units(text: str) -> list[str]:
    """A space and the text, cut before each space that follows another character and leads to one, without
    that first space. No token of either tokenizer reaches over such a cut: pieces of the byte-level pattern
    begin with their space, and no piece of the other vocabulary holds a space after another character."""
    return text.split(" ") if not _TANGLED.search(" " + text) else [u[1:] if k == 0 else u for k, u in enumerate(_EDGE.split(" " + text))]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each stretch, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


class _Vocabulary:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_ragged(self.at[ids], self.size[ids])]


def by_ranks(tokenizer, tokens: list[bytes]):
    """A faster encoder of plain texts with the same ids, where the tokenizer is a byte-level one whose ids follow
    the order of its merges; else none."""
    import tiktoken

    made = json.loads(tokenizer.to_str())
    model, cut = made["model"], made["pre_tokenizer"] or {}
    if model["type"] != "BPE" or made["normalizer"] or (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) != ("ByteLevel", True, False):
        return None
    order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["id"] for t in made["added_tokens"]}
    if any(a >= b for a, b in zip(order, order[1:])) or len(order) + 256 + len(special) != len(tokens):
        return None
    return tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks={t: i for i, t in enumerate(tokens) if i not in special}, special_tokens={}).encode_ordinary


class Aligner:
    """Encodes units with both tokenizers and aligns them. Keeps two generations of encoded units, of at most
    ``most`` each."""

    def __init__(self, a_path: str, b_path: str, most: int = 250_000):
        import sentencepiece

        self.a, self.most = load(a_path), most
        self.a.encode_special_tokens = True
        letters = {chr(v): k for k, v in BYTE_LETTERS.items()}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        tokens = [bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names]
        self.a_bytes, self.plain = _Vocabulary(tokens), by_ranks(self.a, tokens)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = _Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece holds a space after another character")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        both = [np.arange(len(v.size)) for v in (self.a_bytes, self.b_bytes)]
        #: Decimal ids, followed by what may stand after them: a comma, or the end of the side.
        self.shown = [pa.array([f"{i}{end}" for end in (",", last) for i in ids]) for ids, last in zip(both, "|;")]

    def encoded(self, wanted: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each distinct unit under both, as bytes of unsigned 32-bit integers."""
        known, old = self.known.get, self.old.get
        found = [known(u) or old(u) for u in wanted]
        new = [u for u, f in zip(wanted, found) if f is None]
        if new:
            plain = _PLAIN.fullmatch if self.plain else lambda u: None
            a = [self.plain(" " + u) if plain(u) else None for u in new]
            odd = self.a.encode_batch_fast([" " + u for u, x in zip(new, a) if x is None], add_special_tokens=False)
            rest = iter([x.ids for x in odd])
            a = [next(rest) if x is None else x for x in a]
            made = iter([(array("I", x).tobytes(), array("I", y).tobytes()) for x, y in zip(a, self.b.encode(new, num_threads=1))])
            found = [f or next(made) for f in found]
        if len(self.known) + len(wanted) > self.most:
            self.old, self.known = self.known, {}
        self.known.update(zip(wanted, found))
        return found

    def align(self, wanted: list[str]) -> Aligned:
        return Aligned(self, wanted, self.encoded(wanted))


class Aligned:
    """Distinct units aligned: per unit whether both sides give its bytes, numbers of tokens, groups and links,
    its groups as text with a closing semicolon, and its distinct pairs with their links."""

    def __init__(self, by: Aligner, wanted: list[str], ids: list[tuple[bytes, bytes]]):
        n = len(wanted)
        flat = [np.frombuffer(b"".join(x), np.uint32).astype(np.int64) for x in zip(*ids)]
        size = [np.fromiter(map(len, side), np.int64, n) // 4 for side in zip(*ids)]
        raw = [(" " + u).encode() for u in wanted]
        self.good = np.ones(n, bool)
        whole = np.frombuffer(b"".join(raw), np.uint8)
        for vocabulary, side, counts in zip((by.a_bytes, by.b_bytes), flat, size):
            joined = vocabulary.joined(side)
            if len(joined) != len(whole) or not np.array_equal(joined, whole):
                ends = np.cumsum(np.bincount(np.repeat(np.arange(n), counts), vocabulary.size[side], n).astype(np.int64))
                data = joined.tobytes()
                self.good &= np.array([data[a:b] == r for a, b, r in zip(np.append(0, ends[:-1]), ends, raw)])
        if not self.good.all():
            flat = [side[np.repeat(self.good, counts)] for side, counts in zip(flat, size)]
            size = [np.where(self.good, counts, 0) for counts in size]
        self.n_a, self.n_b = size
        ends = [np.cumsum(v.size[side]) for v, side in zip((by.a_bytes, by.b_bytes), flat)]
        common = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(common, e) for e in ends]
        unit_of = np.repeat(np.arange(n), size[0])
        per = [np.bincount(g, minlength=len(common)) for g in group]
        first = [np.cumsum(p) - p for p in per]
        owner = unit_of[first[0]] if len(common) else np.empty(0, np.int64)
        self.n_groups = np.bincount(owner, minlength=n)
        links = per[0] * per[1]
        self.n_links = np.bincount(owner, links, n).astype(np.int64)
        self._texts(by, flat, group, per, first, n)
        self._pairs(flat, group, per, first, links, owner, n)

    def _texts(self, by: Aligner, flat: list, group: list, per: list, first: list, n: int) -> None:
        """Each unit's groups in order: ids of the first side, a bar, ids of the second, a semicolon."""
        parts, sizes, place = [], [], []
        for k, side in enumerate(flat):
            closing = np.diff(group[k], append=-1) != 0
            part = by.shown[k].take(pa.array(side + closing * (len(by.shown[k]) // 2)))
            before = first[1][group[0]] if k == 0 else (first[0] + per[0])[group[1]]
            parts.append(part)
            place.append(np.arange(len(side)) + before)
        both = pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(place), kind="stable")))
        at = both.offsets if hasattr(both, "offsets") else pa.Array.from_buffers(pa.int32(), len(both) + 1, [None, both.buffers()[1]])
        ends = np.cumsum(self.n_a + self.n_b)
        self.text_at = at.to_numpy()[np.append(0, ends)].astype(np.int64)
        self.text = np.frombuffer(both.buffers()[2], np.uint8) if len(both) else np.empty(0, np.uint8)

    def _pairs(self, flat: list, group: list, per: list, first: list, links: np.ndarray, owner: np.ndarray, n: int) -> None:
        wide = np.flatnonzero(links > WIDE)
        narrow = ~np.isin(group[0], wide) if len(wide) else np.ones(len(group[0]), bool)
        g = group[0][narrow]
        keys = (np.repeat(flat[0][narrow], per[1][g]) << spill_count.SIDE) | flat[1][_ragged(first[1][g], per[1][g])]
        unit, m = np.repeat(owner[g], per[1][g]), np.ones(len(keys), np.int64)
        more = [(keys, unit, m)]
        for w in wide:
            a, b = (Counter(side[f[w] : f[w] + p[w]].tolist()) for side, f, p in zip(flat, first, per))
            ia, na, ib, nb = (np.array(list(x), np.int64) for x in (a.keys(), a.values(), b.keys(), b.values()))
            keys = (np.repeat(ia, len(ib)) << spill_count.SIDE) | np.tile(ib, len(ia))
            more.append((keys, np.full(len(keys), owner[w]), np.repeat(na, len(nb)) * np.tile(nb, len(na))))
        keys, unit, m = (np.concatenate(x) for x in zip(*more))
        self.keys, code = np.unique(keys, return_inverse=True)
        both, back = np.unique(unit * max(1, len(self.keys)) + code, return_inverse=True)
        unit, self.code = np.divmod(both, max(1, len(self.keys)))
        self.m = np.bincount(back, m, len(both)).astype(np.int64)
        self.n_pairs = np.bincount(unit, minlength=n)


def _align(a_path: str, b_path: str, chunk_bytes: int, radixes: int):
    kinds = [None, pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    names = ["doc_id", "chunk", "at", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "docs", "radix", "pairs", "n", "doc", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _ALIGNERS.get((a_path, b_path)) or _ALIGNERS.setdefault((a_path, b_path), Aligner(a_path, b_path))
        for seq, batch in enumerate(slices(batches, "text", chunk_bytes)):
            docs, number, cut, codes, n = batch.num_rows, {}, [0], [], 0
            kinds[0] = batch.column("doc_id").type
            for text in batch.column("text").to_pylist():
                if text:
                    words = units(text)
                    for u in words:
                        if u not in number:
                            number[u] = len(number)
                    codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    n += len(words)
                cut.append(n)
            code, cut = np.concatenate([*codes, np.empty(0, np.int32)]).astype(np.int64), np.array(cut, np.int64)
            every = by.align(list(number)) if number else None
            chunk = (TaskContext.get().partitionId() << 32) | seq
            doc = np.repeat(np.arange(docs), np.diff(cut))
            sums, shas = np.zeros((4, docs), np.int64), [""] * docs
            if every is not None:
                bad = np.bincount(doc, ~every.good[code], docs) > 0
                code, doc = code[~bad[doc]], doc[~bad[doc]]
                cut = np.searchsorted(doc, np.arange(docs + 1))
                for k, each in enumerate((every.n_a, every.n_b, every.n_groups, every.n_links)):
                    sums[k] = np.diff(np.append(0, np.cumsum(each[code]))[cut])
                size = np.diff(every.text_at)
                for d in np.flatnonzero(sums[0]):
                    mine = code[cut[d] : cut[d + 1]]
                    shown = every.text[_ragged(every.text_at[mine], size[mine])][:-1]
                    shas[d] = hashlib.sha256(shown).hexdigest()
            none = lambda k: pa.nulls(docs, kinds[k])
            columns = [batch.column("doc_id"), pa.array(np.full(docs, chunk)), pa.array(np.arange(docs, dtype=np.int32)), *(pa.array(s) for s in sums), pa.array(shas)]
            yield pa.RecordBatch.from_arrays([*columns, *(none(k) for k in range(8, 14))], names)
            if every is not None and len(code):
                used, times = np.unique(doc * len(number) + code, return_counts=True)
                doc, code = np.divmod(used, len(number))
                per = every.n_pairs[code]
                at = _ragged((np.cumsum(every.n_pairs) - every.n_pairs)[code], per)
                found, back = np.unique(every.code[at] * docs + np.repeat(doc, per), return_inverse=True)
                m = np.bincount(back, every.m[at] * np.repeat(times, per), len(found)).astype(np.int64)
                pair, doc = np.divmod(found, docs)
                del used, per, at, back
                for row in spill_count.runs_of(every.keys[pair], doc, m, chunk, docs, radixes):
                    c, size, radix, *blobs = row
                    values = [None, c, None, *[None] * 5, size, radix, *blobs]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

    return run


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK, radixes: int = RADIXES, fan: int = spill_count.FAN) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Side A is a byte-level tokenizer over a space and the text, side B a piece model that adds the space. A group
    lies between two byte offsets where tokens of both end; all its A and B tokens are linked. A pair's count is
    the number of rows whose text has it linked, so rows repeated with one id count each. Null and empty texts,
    and texts that the tokens of a side don't give back byte by byte, have zeros and an empty digest. Null ids
    are kept. An empty table gives an empty table. Other columns are not carried.

    Texts are encoded where they are, ``chunk_bytes`` of text at a time, each distinct unit of a chunk once. Links
    are spilled as compressed runs (see ``spill_count``); a document is one row to the end."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, chunk long, at int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, docs int, radix int, pairs binary, n binary, doc binary, m binary"
    made = stored(rows.mapInArrow(lean(_align(a_path, b_path, chunk_bytes, radixes)), schema), "aligned")
    runs = made.filter("radix IS NOT NULL").select("chunk", "docs", "radix", "pairs", "n", "doc", "m")
    back = spill_count.contributions(runs, spill_count.pair_counts(runs, fan))
    base = made.filter("at IS NOT NULL").select("doc_id", "chunk", "at", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return base.join(back, ["chunk", "at"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

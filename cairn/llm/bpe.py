"""Word-wise use of the tokenizers library in tasks: a worker encodes a distinct word once while it is known."""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa

_CODERS: dict[str, WordCoder] = {}
#: Latin words: their lower case is that of each letter, and they are composed already.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The letters that stand for the 256 bytes in a byte-level vocabulary.
BYTE_LETTERS = {b: b for b in _VISIBLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordCoder:
    """Ids of whitespace-separated words under a lower-casing tokenizer that drops white space and encodes the
    words between independently, runs of letters as one piece. Keeps two generations of known words, of
    at most ``most`` words each."""

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer, self.most = load(path), most
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, letters: str) -> bytes:
        """Ids of a lower-case run of letters, by the model alone."""
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, word: str) -> bytes:
        """A closing comma or stop is a piece of its own; other mixed words go through the whole tokenizer."""
        stem = word[:-1] if word[-1] in ",." else word
        if not LATIN.fullmatch(stem):
            return self.whole(word)
        low = stem.lower()
        ids = self.known.get(low) or self.old.get(low) or self.piece(low)
        self.known[low] = ids
        return ids if stem is word else ids + self.closing[word[-1]]

    @property
    def closing(self) -> dict[str, bytes]:
        if "," not in self.known:
            self.known["," ] = self.whole(",")
            self.known["."] = self.whole(".")
        return self.known

    def lookup(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and where each word's begin."""
        words = words.to_pylist()
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        ids = list(map(known.get, words))
        for i, found in enumerate(ids):
            if found is None:
                w = words[i]
                known[w] = ids[i] = old.get(w) or self.encode(w)
        at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)))
        return np.frombuffer(b"".join(ids), "<u4"), at


def coder(path: str) -> WordCoder:
    """One coder per worker process and file."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def gathered(flat: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` numbered ``pick``, one after another, and where each begins."""
    size = at[pick + 1] - at[pick]
    to = np.concatenate(([0], np.cumsum(size)))
    return flat[np.arange(to[-1]) + np.repeat(at[pick] - to[:-1], size)], to

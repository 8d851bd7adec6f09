"""FM-index of one shard: a word sequence, its suffix order, a wavelet matrix over its BWT and sampled
suffix positions. All steps are vectorised over patterns or rows."""

from __future__ import annotations

import numpy as np


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of each suffix. Zeros end a text: each is a symbol of its own, ordered by position before
    all words, so no comparison runs past one. ``text`` must end with a zero. Prefix doubling; only
    suffixes still tied are sorted again."""
    n = len(text)
    zero = text == 0
    start = np.concatenate(([0], np.cumsum(np.bincount(text))))
    rank = start[text].astype(np.int64)
    rank[zero] = np.arange(int(zero.sum()))
    tied, step = np.flatnonzero(~zero), 1
    while len(tied):
        key = rank[tied] * np.int64(n) + rank[tied + step]
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        old, at = rank[tied], np.arange(len(tied))
        first = np.append(True, key[1:] != key[:-1])
        group = np.append(True, old[1:] != old[:-1])
        run = np.maximum.accumulate(np.where(first, at, 0))
        rank[tied] = old + run - np.maximum.accumulate(np.where(group, at, 0))
        single = first & np.append(first[1:], True)
        tied, step = tied[~single], step * 2
    return rank


class Bits:
    """A bit vector with rank in constant time: 64-bit words and the count before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma).bit_length())
        for level in reversed(range(self.depth)):
            bit = ((symbols >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        self.starts = self._down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            i = np.where((symbol >> (self.depth - 1 - k)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        return self._down(symbol, i) - self.starts[symbol]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and how often it stands before i."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(i).astype(np.int64), bits.rank(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.starts[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, every: int = 8):
        """``text``: symbols 1 to sigma and zeros that end texts; the last is a zero. A suffix position
        is kept where it is a multiple of ``every`` or follows a zero, so no walk passes a zero."""
        rank = suffix_ranks(text)
        order = np.empty(len(text), np.int64)
        order[rank] = np.arange(len(text))
        bwt = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))
        self.wavelet = WaveletMatrix(bwt, sigma)
        marked = (bwt == 0) | (order % every == 0)
        self.marked, self.sampled = Bits(marked), order[marked].astype(np.int32)

    def search(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns (stretches of ``symbols``) by backward search."""
        last = symbols[starts + lengths - 1]
        low, high = self.first[last], self.first[last + 1]
        for back in range(2, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = symbols[starts[live] + lengths[live] - back]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a kept suffix position."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.marked.get(rows[live]).astype(bool)
            at = live[done]
            found[at] = self.sampled[self.marked.rank(rows[at])] + steps[at]
            live = live[~done]
            symbol, before = self.wavelet.access_rank(rows[live])
            rows[live] = self.first[symbol] + before
            steps[live] += 1
        return found

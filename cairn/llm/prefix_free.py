"""Prefix-free parsing: the corpus order of a shard's texts from the suffix array of a dictionary of phrases and
the suffix array of the parse, and the windows that occur twice in it."""

from __future__ import annotations

import numpy as np

#: Bytes of a trigger, and one in how many windows is one.
TRIGGER, EVERY = 6, 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAIRS = 8192


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each stretch, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def grams(data: bytes, size: int) -> np.ndarray:
    """The ``size`` bytes (at most 8) at each place as a number; ``data`` is followed by seven bytes of padding."""
    view = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    return view & np.uint64((1 << (8 * size)) - 1) if size < 8 else view


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, for each place of it."""
    new = np.append(True, values[1:] != values[:-1])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _doubled(rank: np.ndarray, left: np.ndarray, h: int) -> np.ndarray:
    """Suffix ranks from the ranks of the first ``h`` symbols, where ``left`` symbols are left to each suffix's end
    (an end sorts first). Equal suffixes share a rank: the number of smaller ones. Only what is still tied and
    not at its end is sorted again."""
    while True:
        tied = np.bincount(rank, minlength=len(rank))[rank] > 1
        at = np.flatnonzero(tied & (left >= h))
        if not len(at):
            return rank
        beyond = left[at] > h
        second = np.where(beyond, rank[np.where(beyond, at + h, 0)], -1)
        order = np.lexsort((second, rank[at]))
        at, second, first = at[order], second[order], rank[at][order]
        both = _starts(first * (len(rank) + 1) + second + 1)
        rank[at] = first + both - _starts(first)
        h *= 2


def suffix_ranks(data: bytes, left: np.ndarray) -> np.ndarray:
    """Rank of the suffix at each place of concatenated strings; ``left`` bytes are left to its string's end."""
    size = np.minimum(left, 7)
    key = grams(data + bytes(8), 7)[: len(left)].byteswap() >> np.uint64(8)
    key = key >> (np.uint64(8) * (7 - size).astype(np.uint64)) << (np.uint64(8) * (7 - size).astype(np.uint64))
    key = (key << np.uint64(8)) | size.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(left), np.int64)
    rank[order] = _starts(key[order])
    return _doubled(rank, left, 7)


class Parse:
    """Texts cut into overlapping phrases where a trigger begins, the dictionary of distinct phrases, and the order
    of all suffixes of both."""

    def __init__(self, texts: list[bytes], size: int):
        self.data = b"".join(t + b"\xff" for t in texts)
        self.size = size
        length = np.array([len(t) + 1 for t in texts], np.int64)
        self.begin = np.cumsum(length) - length
        end = self.begin + length
        hashed = grams(self.data + bytes(8), TRIGGER)[: len(self.data)] * _ODD
        trigger = (hashed >> np.uint64(40)) % np.uint64(EVERY) == 0
        trigger[ragged(np.maximum(end - TRIGGER, self.begin), np.minimum(length, TRIGGER))] = False
        trigger[self.begin] = True
        self.start = np.flatnonzero(trigger)
        text = np.searchsorted(self.begin, self.start, "right") - 1
        following = np.append(self.start[1:], len(self.data))
        self.final = np.append(text[1:] != text[:-1], True)
        stop = np.where(self.final, end[text], following + TRIGGER)
        number: dict[bytes, int] = {}
        data = self.data
        phrase = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(self.start.tolist(), stop.tolist())], np.int64)
        long = np.array([len(p) for p in number], np.int64)
        at = np.cumsum(long) - long
        self.left = np.repeat(at + long, long) - np.arange(long.sum())
        self.rank = suffix_ranks(b"".join(number), self.left)
        self.place = at[phrase]
        count = np.bincount(text)
        first = np.cumsum(count) - count
        order = self.rank[self.place]
        ids = np.unique(order, return_inverse=True)[1]
        by = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by] = _starts(ids[by])
        self.parse_rank = _doubled(rank, np.repeat(first + count, count) - np.arange(len(text)), 1)

    def twice(self, windows: np.ndarray) -> list[np.ndarray]:
        """For each text, which of its first ``windows`` substrings of ``size`` bytes also begin at another place
        among these."""
        p = ragged(self.begin, windows)
        k = np.searchsorted(self.start, p, "right") - 1
        inside = self.place[k] + p - self.start[k]
        left, kind = self.left[inside], self.rank[inside]
        after = np.where(self.final[k], -1, self.parse_rank[np.minimum(k + 1, len(self.start) - 1)])
        order = np.lexsort((after, kind))
        a, b = order[:-1], order[1:]
        own = left - self.final[k]
        same = kind[a] == kind[b]
        equal = same & ((own[a] >= self.size) | (after[a] == after[b]))
        check = np.flatnonzero(~equal & (same | ((own[a] >= self.size) & (own[b] >= self.size))))
        one, two = a[check], b[check]
        whole = ~same[check]
        u, v = (np.where(whole, p[x], self.start[np.minimum(k[x] + 1, len(self.start) - 1)]) for x in (one, two))
        need = np.where(whole, self.size, self.size - left[one] + TRIGGER)
        pairs, back = np.unique(u * len(self.data) + v, return_inverse=True)
        equal[check] = self._common(pairs // len(self.data), pairs % len(self.data))[back] >= need
        found = np.zeros(len(p), bool)
        found[a] |= equal
        found[b] |= equal
        return np.split(found, np.cumsum(windows)[:-1])

    def _common(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Length of the common prefix at two places, up to ``size``."""
        view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.data + b"\xff" * self.size, np.uint8), self.size)
        out = np.empty(len(u), np.int64)
        for a in range(0, len(u), _PAIRS):
            differ = view[u[a : a + _PAIRS]] != view[v[a : a + _PAIRS]]
            out[a : a + _PAIRS] = np.where(differ.any(axis=1), differ.argmax(axis=1), self.size)
        return out


def repeated_windows(texts: list[bytes], windows: np.ndarray, size: int) -> list[np.ndarray]:
    return Parse(texts, size).twice(windows)

"""CRC-32C of many byte strings at once, and the masked form that record framing uses."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x82F63B78
BLOCK = 64
MASK_DELTA = 0xA282EAD8


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def _step(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One zero byte."""
    return table[crc & 0xFF] ^ (crc >> np.uint32(8))


class _Shift:
    """Appends a fixed number of zero bytes; linear, so four byte tables do it."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    def __call__(self, crc: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[0][crc & 0xFF] ^ t[1][(crc >> np.uint32(8)) & 0xFF] ^ t[2][(crc >> np.uint32(16)) & 0xFF] ^ t[3][crc >> np.uint32(24)]

    def twice(self) -> _Shift:
        return _Shift(np.stack([self(self(np.arange(256, dtype=np.uint32) << np.uint32(8 * j))) for j in range(4)]))


_BYTE = _byte_table()
_PAIR = _step(_step(np.arange(65536, dtype=np.uint32), _BYTE), _BYTE)
_ONE = _Shift(np.stack([_step(np.arange(256, dtype=np.uint32) << np.uint32(8 * j), _BYTE) for j in range(4)]))
_POWERS = [_ONE]
while len(_POWERS) < 40:
    _POWERS.append(_POWERS[-1].twice())
_BLOCK_SHIFT = _POWERS[BLOCK.bit_length() - 1]


def crc32c(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksums of consecutive strings in ``data`` (uint8) that end at ``ends``."""
    ends = np.asarray(ends, np.int64)
    sizes = np.diff(ends, prepend=0)
    blocks = -(-sizes // BLOCK)
    block_ends = np.cumsum(blocks)
    # each string is padded in front with zeros, which leave a checksum that starts at zero alone
    padded = np.zeros((int(blocks.sum()), BLOCK), np.uint8)
    shift = block_ends * BLOCK - ends
    padded.reshape(-1)[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    pairs = np.ascontiguousarray(padded.view("<u2").T)
    part = np.zeros(padded.shape[0], np.uint32)
    for column in pairs:
        part = _PAIR[(part & 0xFFFF) ^ column] ^ (part >> np.uint32(16))
    crc, starts = np.zeros(len(sizes), np.uint32), block_ends - blocks
    live, k = np.flatnonzero(blocks), 0
    while len(live):
        crc[live] = _BLOCK_SHIFT(crc[live]) ^ part[starts[live] + k]
        k += 1
        live = live[blocks[live] > k]
    start = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for bit in range(int(sizes.max(initial=0)).bit_length()):
        at = np.flatnonzero((sizes >> bit) & 1)
        start[at] = _POWERS[bit](start[at])
    return crc ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)

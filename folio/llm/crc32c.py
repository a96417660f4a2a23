"""CRC-32C (Castagnoli) of many byte strings at once, in numpy.

A checksum is linear: rows of 64 bytes are done side by side, each is carried
over the bytes behind it by tables of the shift by powers of two, and the rows of
a string are added up.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: the polynomial, bits reversed.
POLYNOMIAL = 0x82F63B78
ROW = 64
_ALL = np.uint32(0xFFFFFFFF)


@lru_cache(1)
def table() -> np.ndarray:
    """The checksum of each single byte, without the inversions."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & np.uint32(1), crc >> np.uint32(1) ^ np.uint32(POLYNOMIAL), crc >> np.uint32(1))
    return crc


def _carried(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return tables[0][crc & low] ^ tables[1][crc >> np.uint32(8) & low] ^ tables[2][crc >> np.uint32(16) & low] ^ tables[3][crc >> np.uint32(24)]


@lru_cache(64)
def shift(power: int) -> np.ndarray:
    """Tables that carry a checksum over 2**power zero bytes, one for each of its bytes."""
    if power:
        half = shift(power - 1)
        return np.stack([_carried(half, x) for x in half])
    values = np.arange(256, dtype=np.uint32)
    return np.stack([table()[values], *(values << np.uint32(8 * (k - 1)) for k in (1, 2, 3))])


def _carry(crc: np.ndarray, count: np.ndarray, unit: int) -> None:
    """Carries each checksum over ``count`` times 2**unit zero bytes."""
    for bit in range(int(count.max()).bit_length() if len(count) else 0):
        at = np.flatnonzero(count >> bit & 1)
        crc[at] = _carried(shift(bit + unit), crc[at])


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32C of each ``data[start:end]``, as unsigned 32-bit integers."""
    size = np.asarray(ends, np.int64) - np.asarray(starts, np.int64)
    rows = -(-size // ROW)
    stop = np.cumsum(rows)
    # Zeros before a string don't change it, so each ends where its last row does.
    flat = np.zeros(int(rows.sum()) * ROW, np.uint8)
    for a, b, to in zip(np.asarray(starts).tolist(), np.asarray(ends).tolist(), (stop * ROW).tolist(), strict=True):
        flat[to - (b - a) : to] = data[a:b]
    columns = np.ascontiguousarray(flat.reshape(-1, ROW).T)
    crc = np.zeros(columns.shape[1], np.uint32)
    single, low, byte = table(), np.uint32(255), np.uint32(8)
    for column in columns:
        crc = single[(crc ^ column) & low] ^ crc >> byte
    _carry(crc, np.repeat(stop, rows) - 1 - np.arange(len(crc)), ROW.bit_length() - 1)
    out = np.zeros(len(size), np.uint32)
    some = np.flatnonzero(rows)
    if len(some):
        out[some] = np.bitwise_xor.reduceat(crc, (stop - rows)[some])
    start = np.full(len(size), _ALL)
    _carry(start, size, 0)
    return out ^ start ^ _ALL

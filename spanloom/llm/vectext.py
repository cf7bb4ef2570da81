"""Tokens and hashes of whole Arrow batches of text with NumPy, without a Python object per word.

All separators are ASCII, so UTF-8 bytes can be cut without decoding them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for bytes of item words (after LOWER) and of white-space words.
ITEM = np.zeros(256, bool)
ITEM[48:58] = ITEM[97:123] = ITEM[128:] = True
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of text at a time; the arrays of one run take some 60 times as much.
CHUNK = 1 << 18


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task would keep it from the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; null rows are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), offsets


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``most`` bytes; one row is never cut."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        own = offsets[row : end + 1] - offsets[row]
        yield row, end, data[offsets[row] : offsets[end]], own
        row = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of member bytes; runs don't cross rows."""
    start, end = spans(member, offsets)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes; runs don't cross rows."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = np.flatnonzero(member[1:] != member[:-1]) + 1
    turn = np.concatenate([np.zeros(int(member[0]), np.int64), turn, np.full(int(member[-1]), len(member))])
    start, end = turn[::2], turn[1::2]
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(member))])
    inner = inner[member[inner - 1] & member[inner]]
    if len(inner):
        start, end = np.insert(start, np.searchsorted(start, inner), inner), np.insert(end, np.searchsorted(end, inner), inner)
    return start, end


def item_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z in lower case, and which of them belong to item words."""
    low = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    return low, (low - np.uint8(97) < 26) | (low - np.uint8(48) < 10) | (low > 127)


_WORD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def quick_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, read eight bytes at a time."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.zeros(-(-len(data) // 8) * 8 + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint64), (len(data),), (1,))
    size = end - start
    with np.errstate(over="ignore"):
        out = mix64(eight[start] & _WORD[np.minimum(size, 8)] ^ size.astype(np.uint64) * _PLACE[61])
        more, at = np.flatnonzero(size > 8), 8
        while len(more):
            out[more] = mix64(out[more] * _STEP + (eight[start[more] + at] & _WORD[np.minimum(size[more] - at, 8)]))
            at += 8
            more = more[size[more] > at]
    return out


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, row and number within its row of each line; lines are cut at line feeds."""
    feed = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], feed + 1]))
    start = start[start < len(data)]
    row = np.searchsorted(offsets, start, "right") - 1
    return start, row, np.searchsorted(feed, start) - np.searchsorted(feed, offsets[row])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans are in order and not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), _STEP, np.uint64))
        value = _BYTE[data[at + np.repeat(start, size)]] * power[at]
        return mix64(np.add.reduceat(value, begin) + size.astype(np.uint64) * _PLACE[63])


def windows(hashes: np.ndarray, row: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``width`` tokens within a row; a row of fewer tokens, but not none, gives one of all if ``short``."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            whole += hashes[k : n - width + 1 + k] * _PLACE[k] if len(whole) else 0
        same = row[: len(whole)] == row[width - 1 :] if len(whole) else np.zeros(0, bool)
        out, of = mix64(whole[same]), row[: len(whole)][same]
        if short and n:
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size = np.diff(np.r_[begin, n])
            few = size < width
            if few.any():
                place = np.arange(n) - np.repeat(begin, size)
                value = np.add.reduceat(hashes * _PLACE[np.minimum(place, 31)], begin)[few]
                out = np.r_[out, mix64(value + size[few].astype(np.uint64) * _PLACE[62])]
                of = np.r_[of, row[begin[few]]]
                order = np.argsort(of, kind="stable")
                out, of = out[order], of[order]
    return out, of

"""Whole texts as byte arrays: words, hashes of words and windows, and a vectorised hash index (numpy only)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Masks that keep the first 0 .. 8 bytes of a lane.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
ROLL = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def fmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def strings(column) -> pa.Array:
    """A string column with nulls as empty texts, in one piece."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column, "") if column.null_count else column


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset at which each begins (one more than texts)."""
    a = strings(column)
    n = len(a)
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + n + 1].astype(np.int64)
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batches: Iterator, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with at most ``limit`` bytes of text each (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = raw(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """Gives freed memory back to the system, as a worker may next serve a stage of another kind."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(run: Callable) -> Callable:
    """A function of one group or two that gives its memory back afterwards."""

    def one(group):
        result = run(group)
        trim()
        return result

    def two(left, right):
        result = run(left, right)
        trim()
        return result

    return one if run.__code__.co_argcount == 1 else two


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each run without the six ASCII blanks, and the number of the first word of each text."""
    n = len(data)
    solid = np.ones(n + 1, bool)
    solid[:n] = (data != 32) & ((data < 9) | (data > 13))
    solid[n] = False
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:]
    ends = solid[:-1] & (~solid[1:] | edge[1:])
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, off)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number (beyond the end: zeros)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,), writeable=False)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, eights: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes a step; spans of up to eight bytes differ only in the length mix."""
    eights = lanes(data) if eights is None else eights
    size = ends - starts
    short = np.clip(size, 0, 8)
    out = fmix((eights[starts] & _KEEP[short]) ^ (size.astype(U64) * U64(0x8EBC6AF09C88C6E3)))
    todo = np.flatnonzero(size > 8)
    at = 8
    while len(todo):
        left = size[todo] - at
        lane = eights[starts[todo] + at] & _KEEP[np.minimum(left, 8)]
        out[todo] = fmix((out[todo] * U64(0x9FB21C651E98DF25)) ^ lane)
        at += 8
        todo = todo[left > 8]
    return out


def powers(m: int | np.uint64, n: int) -> np.ndarray:
    """m**0 .. m**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), U64(m), U64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def inverse(m: int | np.uint64) -> np.uint64:
    return U64(pow(int(m), -1, 1 << 64))


def windows_hash(word_hash: np.ndarray, first: np.ndarray, width: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside one text: (number of its first word, hash), in order."""
    n = len(word_hash)
    count = np.maximum(np.diff(first) - width + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    begin = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(total)
    m = ROLL[lane]
    total_sum = np.zeros(n + 1, U64)
    np.cumsum(word_hash * powers(m, n), out=total_sum[1:])
    return begin, fmix((total_sum[begin + width] - total_sum[begin]) * powers(inverse(m), n)[begin])


class HashIndex:
    """64-bit keys -> numbers 0, 1, 2 ... in order of insertion; open addressing, looked up and filled as arrays."""

    def __init__(self, bits: int = 16):
        self.size = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U64)
        self.vals = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is new."""
        at = (keys & U64(self.mask)).astype(np.int64)
        out = self.vals[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.vals[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[at[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """New, distinct keys; they get the next numbers."""
        nums = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        if (self.size + len(keys)) * 2 > self.mask:
            used = self.vals >= 0
            old_keys, old_vals = self.keys[used], self.vals[used]
            bits = max(16, int(self.size + len(keys)).bit_length() + 1)
            self._make(bits)
            self._put(old_keys, old_vals)
        self._put(keys, nums)
        self.size += len(keys)

    def _put(self, keys: np.ndarray, nums: np.ndarray) -> None:
        at = (keys & U64(self.mask)).astype(np.int64)
        while len(keys):
            free = self.vals[at] < 0
            self.vals[at[free]] = nums[free]
            self.keys[at[free]] = keys[free]
            lost = self.vals[at] != nums
            keys, nums, at = keys[lost], nums[lost], (at[lost] + 1) & self.mask


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1 .. for size[0] places, then the same of the next."""
    total = int(size.sum())
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)

"""Words of whole Arrow string columns as numpy arrays: exact integer codes, 64-bit hashes, runs."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Odd multiplier of word sequences.
SEQ = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column; null counts as empty."""
    column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word `[^\\x20\\x09-\\x0D]+`, in order; no word crosses rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes without what lies between, and their offsets."""
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1) if len(starts) < 64 else inside.__setitem__(starts, 1)
    # a word may begin where another row's word ends: count both
    closing = np.zeros(len(data) + 1, np.int8)
    closing[ends] = 1
    keep = np.cumsum(inside - closing, dtype=np.int8)[:-1] > 0
    out = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=out[1:])
    return data[keep], out


def coded(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Exact integer code of each word, and the distinct words by code. body, offsets: from packed()."""
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    coded_words = words.dictionary_encode()
    return coded_words.indices.to_numpy(), coded_words.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each of some distinct words."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.to_pylist()), np.uint64, len(words))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries, by doubling: len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, out, size, power, bit = len(h) - k + 1, None, 0, SEQ, 1
    block = h
    while True:
        if k & bit:
            if out is None:
                out, size = block[:n], bit
            else:
                # entries already taken come first
                out = out * power_of(bit) + block[size : size + n]
                size += bit
        bit <<= 1
        if bit > k:
            return mix(out)
        half = bit >> 1
        block = block[: len(block) - half] * power_of(half) + block[half:]


def power_of(n: int) -> np.uint64:
    return U(pow(int(SEQ), n, 1 << 64))


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive entries, by doubling."""
    n, span = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while span * 2 <= k:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return x[:n] if span == k else np.minimum(x[:n], x[k - span : k - span + n])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all half-open ranges, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    at = np.cumsum(lengths)[:-1]
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    out[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def give_back() -> None:
    """What Arrow and numpy no longer use goes back to the system: workers wait for their next task beside others that run."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch, column: int, size: int = 2_000_000):
    """Slices of a batch with about `size` bytes of text in a column, a long row alone. What is no longer used goes back to the system after each."""
    n = batch.num_rows
    if not n:
        return
    piece = np.cumsum(np.diff(text_buffers(batch.column(column))[1])) // size
    cuts = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), n)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)
        give_back()

"""Range asymmetric numeral system with a static table: blocks of interleaved lanes, with checkpoints.

Symbol i of a block belongs to lane i % LANES; a step codes one symbol of every lane.  A lane's state is a 64-bit number from LOW up to LOW << 32
and sheds 32-bit words.  Every STEPS steps the states are kept, with the number of words before them: decoding can begin at each such checkpoint, and
decode() reads all of a block's segments side by side.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES, STEPS, SEGMENTS = 512, 128, 4
#: Symbols between two checkpoints, and of a block.
SEGMENT = LANES * STEPS
BLOCK = SEGMENT * SEGMENTS
LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to a sum of 2**bits, at least 1 for every symbol that occurs; what rounding leaves goes to, or comes from, the most frequent."""
    total, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    if not total:
        return out
    used = np.flatnonzero(counts)
    if len(used) > 1 << (bits - 1):
        raise ValueError(f"{len(used)} symbols need a table of more than {bits} bits")
    out[used] = np.maximum(1, [int(c) * (1 << bits) // total for c in counts[used]])
    over = int(out.sum()) - (1 << bits)
    for i in used[np.argsort(-out[used], kind="stable")]:
        step = min(over, int(out[i]) - 1) if over > 0 else over
        out[i] -= step
        over -= step
        if not over:
            break
    return out


class Coder:
    """Encodes and decodes blocks under one table of frequencies that add up to 2**bits."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Words (little-endian, 32 bits), and the checkpoints: for each segment the number of words before it and the lanes' states (64 bits each)."""
        k, limit = np.uint64(self.bits), np.uint64(63 - self.bits)
        state = np.full(LANES, LOW, np.uint64)
        words, kept, n = [], [], 0
        for t in range(-(-len(ids) // LANES) - 1, -1, -1):
            step = ids[t * LANES : (t + 1) * LANES]
            f, x = self.freq[step], state[: len(step)]
            full = x >= f << limit
            out = x[full]
            words.append(out.astype(np.uint32))
            n += len(out)
            x[full] = out >> _WORD
            q = x // f
            x[:] = (q << k) + (x - q * f) + self.start[step]
            if t % STEPS == 0:
                kept.append((n, state.copy()))
        payload = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        marks = [np.append(np.uint64(n - seen), at) for seen, at in reversed(kept)]
        return payload.astype("<u4").tobytes(), np.array(marks, "<u8").tobytes()

    def decode(self, payload: bytes, marks: bytes, n: int) -> np.ndarray:
        """The n symbols of a block."""
        words = np.append(np.frombuffer(payload, "<u4").astype(np.uint64), np.uint64(0))
        table = np.frombuffer(marks, "<u8").reshape(-1, LANES + 1)
        at, x = table[:, 0].astype(np.int64), table[:, 1:].astype(np.uint64)
        out = np.zeros((len(table), STEPS, LANES), np.uint32)
        left = n - SEGMENT * np.arange(len(table))
        mask, k, lane = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.arange(LANES)
        for t in range(STEPS):
            live = lane < (left - t * LANES)[:, None]
            if not live.any():
                break
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            out[:, t] = s
            y = self.freq[s] * (x >> k) + slot - self.start[s]
            short = live & (y < LOW)
            place = at[:, None] + np.cumsum(short, axis=1) - 1
            at += short.sum(axis=1)
            x = np.where(live, np.where(short, (y << _WORD) | words[np.where(short, place, -1)], y), x)
        return out.reshape(-1)[:n]


def checksum(payload: bytes, marks: bytes) -> int:
    return zlib.crc32(marks, zlib.crc32(payload))


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a string from (CRC-32, length in bytes) of its parts, in order: a part's remainder is moved on by the length of what follows."""
    total = 0
    for crc, size in parts:
        total = _times(total, _power(8 * size)) ^ crc
    return total


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC's, bits reversed as in the CRC itself."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
        b = (b << 1) & 0xFFFFFFFF
    return out


def _power(n: int) -> int:
    """x to the n-th."""
    out, base = 0x80000000, 0x40000000
    while n:
        if n & 1:
            out = _times(out, base)
        base = _times(base, base)
        n >>= 1
    return out

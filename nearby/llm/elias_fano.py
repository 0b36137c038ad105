"""Elias-Fano coded non-decreasing sequences with a sampled select directory."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 512
HEAD = struct.Struct("<QQB")


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing uint64 sequence: about 2 + log2(range / n) bits each, and a directory of every 512th one."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    low_bits = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
    low = v & np.uint64((1 << low_bits) - 1)
    at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(at[-1]) if n else 0) // 8 * 8 + 8, np.uint8)
    high[at] = 1
    bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low_bits else np.zeros((0, 0), np.uint8)
    return HEAD.pack(n, len(high) // 8, low_bits) + np.packbits(high).tobytes() + at[::SAMPLE].astype("<u8").tobytes() + np.packbits(bits.ravel()).tobytes()


class Sequence:
    """Random access to an encoded sequence without expanding it."""

    def __init__(self, raw: bytes):
        self.n, size, self.low_bits = HEAD.unpack_from(raw)
        at = HEAD.size
        self.high = np.frombuffer(raw, np.uint8, size, at)
        at += size
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(raw, "<u8", samples, at)
        at += 8 * samples
        low_size = -(-self.n * self.low_bits // 8)
        self.low = np.frombuffer(raw, np.uint8, low_size, at)
        self.size = at + low_size

    def select(self, first: int, last: int) -> np.ndarray:
        """Values number ``first`` up to, not including, ``last``."""
        if first >= last:
            return np.zeros(0, np.uint64)
        s = first // SAMPLE
        start = int(self.samples[s]) // 8
        nxt = -(-last // SAMPLE)
        stop = int(self.samples[nxt]) // 8 + 1 if nxt < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:stop])) + 8 * start
        ones = ones[ones >= int(self.samples[s])][first - s * SAMPLE : last - s * SAMPLE]
        top = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return top
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)])[a % 8 : a % 8 + b - a].reshape(-1, self.low_bits).astype(np.uint64)
        return top | (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

"""Wavelet matrix over an integer sequence: bit-planes with rank and select.

Plane ``l`` holds bit ``levels-1-l`` of every value, in the order that a
stable partition by the planes above gives. Ranks come from a running count
of ones per 64-bit word. All queries take numpy arrays of positions.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEADER = struct.Struct("<4sIQ")
MAGIC = b"WVM1"


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bits as little-endian 64-bit words, with one word more than needed."""
    words = np.zeros(len(bits) // 64 + 1, "<u8")
    packed = np.packbits(bits, bitorder="little")
    words.view(np.uint8)[: len(packed)] = packed
    return words


class Bits:
    """A bit vector with rank and select."""

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        self.ranks = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.ranks[1:])

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        return cls(_pack(bits), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, np.int64)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero; k must exist."""
        k = np.asarray(k, np.int64)
        if one:
            w = np.searchsorted(self.ranks, k, "right") - 1
            left, word = k - self.ranks[w], self.words[w]
        else:
            zeros = np.arange(len(self.ranks), dtype=np.int64) * 64 - self.ranks
            w = np.searchsorted(zeros, k, "right") - 1
            left, word = k - zeros[w], ~self.words[w]
        at = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            part = (word >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            over = left >= ones
            left = np.where(over, left - ones, left)
            at = np.where(over, at + half, at)
        return w * 64 + at


class WaveletMatrix:
    def __init__(self, planes: list[Bits], n: int):
        self.planes, self.n, self.levels = planes, n, len(planes)
        self.zeros = [n - int(p.ranks[-1]) for p in planes]

    @classmethod
    def of(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        kind = np.uint16 if levels <= 16 else np.uint32
        values, planes = np.asarray(values).astype(kind), []
        for shift in range(levels - 1, -1, -1):
            bits = (values & kind(1 << shift)) != 0
            planes.append(Bits.of(bits))
            values = np.concatenate([values.take(np.flatnonzero(~bits)), values.take(np.flatnonzero(bits))])
        return cls(planes, len(values))

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.get(at).astype(np.int64), plane.rank1(at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            out = out << 1 | bit
        return out

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value occurs before the position beside it."""
        value, hi = np.asarray(value, np.int64), np.asarray(at, np.int64)
        lo = np.zeros(len(hi), np.int64)
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            one = value >> (self.levels - 1 - level) & 1 == 1
            lo1, hi1 = plane.rank1(lo), plane.rank1(hi)
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def count(self, value: int) -> int:
        return int(self.rank(np.array([value]), np.array([self.n]))[0])

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) occurrences of one value; each k must be below its count."""
        lo = 0
        path = []
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            one = bool(value >> (self.levels - 1 - level) & 1)
            ones = int(plane.rank1(np.array([lo]))[0])
            lo = zeros + ones if one else lo - ones
            path.append(one)
        at = lo + np.asarray(k, np.int64)
        for plane, zeros, one in zip(self.planes[::-1], self.zeros[::-1], path[::-1], strict=True):
            at = plane.select(at - zeros if one else at, one)
        return at

    def occurrences(self, value: int) -> np.ndarray:
        return self.select(value, np.arange(self.count(value)))

    def values(self) -> np.ndarray:
        """The whole sequence: the partitions undone from the last plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bits, zeros = self.planes[level].bits(), self.zeros[level]
            merged = np.empty(self.n, kind)
            merged[np.flatnonzero(~bits)] = out[:zeros]  # index arrays: masks would be slower here
            merged[np.flatnonzero(bits)] = out[zeros:] | kind(1 << (self.levels - 1 - level))
            out = merged
        return out

    def to_bytes(self) -> bytes:
        """Header, then the planes, compressed."""
        planes = b"".join(p.words.astype("<u8", copy=False).tobytes() for p in self.planes)
        return _HEADER.pack(MAGIC, self.levels, self.n) + zstandard.ZstdCompressor(level=1).compress(planes)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, levels, n = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        size = (n // 64 + 1) * 8
        raw = zstandard.ZstdDecompressor().decompress(data[_HEADER.size :], max_output_size=size * levels or 1)
        return cls([Bits(np.frombuffer(raw, "<u8", n // 64 + 1, level * size), n) for level in range(levels)], n)

"""Wavelet matrix of token ids: one bit plane per binary digit, with rank and select.

A plane holds the digit of every id, highest digit first; below it the ids
with a 0 come first, then those with a 1, each in their former order. So an id
is read, counted or located with one rank or select per plane.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of a rank block; the directory holds the ones before each.
BLOCK = 512
_WORDS = BLOCK // 64


@dataclass
class Plane:
    """Bits packed highest first, padded to whole blocks, and the ones before each block."""

    bits: np.ndarray
    before: np.ndarray
    zeros: int

    @classmethod
    def of(cls, bit: np.ndarray) -> Plane:
        packed = np.zeros(-(-(len(bit) + 1) // BLOCK) * BLOCK // 8, np.uint8)
        packed[:-(-len(bit) // 8)] = np.packbits(bit)
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, _WORDS).sum(axis=1, dtype=np.int64)
        before = (np.cumsum(ones) - ones).astype("<u4")
        return cls(packed, before, len(bit) - int(ones.sum()))

    def unpack(self, n: int) -> np.ndarray:
        return np.unpackbits(self.bits, count=n).view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        words = self.bits.view(">u8").astype(np.uint64)
        total, first = self.before[at // BLOCK].astype(np.int64), at // BLOCK * _WORDS
        last = at >> 6
        for i in range(_WORDS):
            whole = first + i < last
            total += np.where(whole, np.bitwise_count(words[np.where(whole, first + i, 0)]), 0)
        part = (at & 63).astype(np.uint64)
        shifted = np.where(part > 0, words[last] >> (np.uint64(64) - np.where(part > 0, part, np.uint64(1))), np.uint64(0))
        return total + np.bitwise_count(shifted)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero: the block by its directory, the bit by halving."""
        starts = np.arange(len(self.before), dtype=np.int64) * BLOCK
        ahead = self.before.astype(np.int64) if one else starts - self.before
        low = starts[np.searchsorted(ahead, k, side="right") - 1]
        high = low + BLOCK
        while (high - low > 1).any():
            middle = (low + high) // 2
            inside = np.minimum(middle, len(self.bits) * 8 - 1)
            count = self.ones(inside)
            count = count if one else inside - count
            up = count > k
            high, low = np.where(up, middle, high), np.where(up, low, middle)
        return low


def _split(ids: np.ndarray, bit: np.ndarray, zeros: int, step: int = 1 << 16) -> np.ndarray:
    """Ids with a 0, then those with a 1, in pieces that stay in the processor's cache."""
    out, low, high = np.empty_like(ids), 0, zeros
    for i in range(0, len(ids), step):
        part, one = ids[i:i + step], bit[i:i + step]
        ones = np.compress(one, part)
        out[high:high + len(ones)] = ones
        high += len(ones)
        out[low:low + len(part) - len(ones)] = np.compress(~one, part)
        low += len(part) - len(ones)
    return out


@dataclass
class WaveletMatrix:
    size: int
    planes: list[Plane]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        rest = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes = []
        for shift in range(levels - 1, -1, -1):
            bit = (rest & rest.dtype.type(1 << shift)) != 0
            planes.append(Plane.of(bit))
            rest = _split(rest, bit, planes[-1].zeros)
        return cls(len(ids), planes)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        rest = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for shift, plane in enumerate(reversed(self.planes)):
            bit, above = plane.unpack(self.size), np.empty_like(rest)
            above[np.flatnonzero(~bit)] = rest[:plane.zeros]
            above[np.flatnonzero(bit)] = rest[plane.zeros:] | rest.dtype.type(1 << shift)
            rest = above
        return rest.astype(np.uint32)

    def access(self, at: np.ndarray) -> np.ndarray:
        at, ids = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for plane in self.planes:
            bit, ones = plane.get(at), plane.ones(at)
            ids = ids << np.uint32(1) | bit
            at = np.where(bit == 1, plane.zeros + ones, at - ones)
        return ids

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        at = np.array([low, high], np.int64)
        if token >> len(self.planes):
            return 0, 0
        for shift, plane in zip(range(len(self.planes) - 1, -1, -1), self.planes):
            ones = plane.ones(at)
            at = plane.zeros + ones if token >> shift & 1 else at - ones
        return int(at[0]), int(at[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token at places from ``low`` up to ``high``."""
        a, b = self._range(token, low, self.size if high is None else high)
        return b - a

    def locate(self, token: int) -> np.ndarray:
        """Places of all occurrences, ascending."""
        at = np.arange(*self._range(token, 0, self.size), dtype=np.int64)
        for shift, plane in enumerate(reversed(self.planes)):
            one = bool(token >> shift & 1)
            at = plane.select(at - plane.zeros if one else at, one)
        return at

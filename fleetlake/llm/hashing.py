"""Rolling hashes of arrays of numbers, modulo 2 to the 64."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def run_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``n`` values."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    value, out, size = values.astype(np.uint64) * _MIX + np.uint64(1), None, 0
    width, power = 1, _BASE
    while n:
        if n & 1:
            # The runs so far are followed by the next ``width`` values.
            out = value if out is None else out[:len(value) - size] * power + value[size:]
            size += width
        n >>= 1
        if n:
            value = value[:-width] * power + value[width:]
            power, width = np.uint64(int(power) ** 2 % (1 << 64)), width * 2
    return out[:len(values) - size + 1]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits, one to one."""
    x = (hashes ^ (hashes >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Table:
    """Numbers by 64-bit key in open addressing; an absent key gives ``missing``."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float = np.nan):
        self.missing, self.used = missing, 0
        self._empty(len(keys), values.dtype)
        self._put(keys, values)

    def _empty(self, n: int, kind: np.dtype) -> None:
        self.bits = max(4, int(2 * n).bit_length())
        self.keys, self.values = np.full(1 << self.bits, self.EMPTY), np.full(1 << self.bits, self.missing, kind)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            slots, pick = np.unique(at[free], return_index=True)
            put = free[pick]
            self.keys[slots], self.values[slots] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)
        self.used += len(keys)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet; the table grows with them."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            full = self.keys != self.EMPTY
            old, self.used = (self.keys[full], self.values[full]), 0
            self._empty(2 * (len(old[0]) + len(keys)), self.values.dtype)
            self._put(*old)
        self._put(keys, values)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        open_ = np.flatnonzero((found != keys) & (found != self.EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != self.EMPTY)]
        return self.values[at]

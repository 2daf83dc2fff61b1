"""Balanced parentheses of a tree: two bits a node, with the excess of blocks for jumps over whole subtrees."""

from __future__ import annotations

import numpy as np

#: Bits of a block; the directory holds the excess before each block and its least excess.
BLOCK = 64


class Parentheses:
    """1 opens a node, 0 closes it; nodes are numbered by their opening bits (pre-order)."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        self.bits = np.packbits(np.pad(bits.astype(bool), (0, -self.size % BLOCK)))
        steps = np.where(bits, 1, -1)
        steps = np.pad(steps, (0, -self.size % BLOCK)).reshape(-1, BLOCK).cumsum(axis=1)
        ends = steps[:, -1].cumsum()
        self.before = np.concatenate(([0], ends))[:-1]
        # Least excess of a block, then of pairs of blocks, and so on up.
        self.least = [self.before + steps.min(axis=1)] if self.size else [np.zeros(1, np.int64)]
        while len(self.least[-1]) > 1:
            row = self.least[-1]
            self.least.append(np.pad(row, (0, len(row) % 2), constant_values=1 << 60).reshape(-1, 2).min(axis=1))
        pairs = bits & ~np.append(bits[1:], True)
        self.pairs = np.packbits(np.pad(pairs, (0, -self.size % BLOCK)))
        counts = np.bitwise_count(self.pairs.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
        self.pairs_before = np.concatenate(([0], np.cumsum(counts)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1

    def opens(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.bits, count=self.size))

    def leaf_pairs(self, at: np.ndarray) -> np.ndarray:
        """Opening bits before each place that are closed at once: leaves."""
        whole, part = at // BLOCK, at % BLOCK
        words = np.append(self.pairs.view(">u8").astype(np.uint64), np.uint64(0))
        shift = np.where(part > 0, BLOCK - part, 1).astype(np.uint64)
        return self.pairs_before[whole] + np.bitwise_count(np.where(part > 0, words[whole] >> shift, np.uint64(0)))

    def _scan(self, at: np.ndarray, excess: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place from ``at`` to the end of its block where the excess is ``target``, or -1; ``excess`` is that before ``at``."""
        found, todo = np.full(len(at), -1, np.int64), np.arange(len(at))
        at, excess = at.copy(), excess.copy()
        while len(todo):
            inside = at[todo] < np.minimum((at[todo] // BLOCK + 1) * BLOCK, self.size)
            todo = todo[inside]
            excess[todo] += 2 * self.get(at[todo]).astype(np.int64) - 1
            hit = excess[todo] == target[todo]
            found[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] % BLOCK != 0]
        return found, excess

    def excess(self, at: np.ndarray) -> np.ndarray:
        """Opening less closing bits before each place."""
        whole, part = at // BLOCK, at % BLOCK
        words = np.append(self.bits.view(">u8").astype(np.uint64), np.uint64(0))
        shift = np.where(part > 0, BLOCK - part, 1).astype(np.uint64)
        ones = np.bitwise_count(np.where(part > 0, words[whole] >> shift, np.uint64(0))).astype(np.int64)
        return np.append(self.before, 0)[whole] + 2 * ones - part

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The bit that closes each opening bit: in its block, or in the next block whose least excess is low enough."""
        target = self.excess(at)
        found, _ = self._scan(at + 1, target + 1, target)
        # A bit that ends its block has nothing left to scan in it.
        found[(at + 1) % BLOCK == 0] = -1
        far = np.flatnonzero(found < 0)
        node, goal, level = at[far] // BLOCK, target[far], np.full(len(far), -1)
        for k, least in enumerate(self.least):
            up = np.flatnonzero(level < 0)
            right = np.minimum(node[up] + 1, len(least) - 1)
            hit = (node[up] % 2 == 0) & (node[up] + 1 < len(least)) & (least[right] <= goal[up])
            node[up[hit]] += 1
            level[up[hit]] = k
            node[up[~hit]] >>= 1
        for k in range(len(self.least) - 2, -1, -1):
            down = np.flatnonzero(level > k)
            left = 2 * node[down]
            node[down] = np.where(self.least[k][left] <= goal[down], left, left + 1)
        found[far], _ = self._scan(node * BLOCK, self.before[node], goal)
        return found


class RangeLeast:
    """Least value of any range, from the least of all ranges of a power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            row, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(row[:-half], row[half:]))

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp((end - first).astype(float))[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for k, row in enumerate(self.rows):
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(row[first[here]], row[end[here] - (1 << k)])
        return out

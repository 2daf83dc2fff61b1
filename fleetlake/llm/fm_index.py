"""FM-index over word numbers: backward search on a wavelet matrix of the Burrows-Wheeler transform.

Suffixes are sorted by their first ``2 ** ROUNDS`` words only, which is all a
search of up to as many words can tell apart. Common prefixes of neighbours,
cut at the threshold, let a match give up words at its right end.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A plane of bits with the ones before each word of 64."""

    def __init__(self, bit: np.ndarray):
        n = len(bit)
        self.words = np.packbits(np.pad(bit, (0, 64 - n % 64))).view(">u8").astype(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.cumsum(ones, dtype=np.uint32) - ones
        self.zeros = n - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, part = at >> 6, (at & 63).astype(np.uint64)
        # Two shifts, since one of 64 bits is none.
        head = (self.words[word] >> np.uint64(1)) >> (np.uint64(63) - part)
        return self.before[word].astype(np.int64) + np.bitwise_count(head)

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 6] >> (np.uint64(63) - (at & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Planes of bits, highest first; below a plane the numbers with a 0 come first."""

    def __init__(self, numbers: np.ndarray, most: int):
        self.levels = max(1, int(most).bit_length())
        rest, self.planes = numbers.astype(np.uint32), []
        for shift in range(self.levels - 1, -1, -1):
            bit = (rest >> np.uint32(shift) & np.uint32(1)).astype(bool)
            self.planes.append(Bits(bit))
            rest = np.concatenate((rest[~bit], rest[bit]))

    def rank(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of ``number`` in the last order among the first ``at`` ones; differences are counts."""
        for shift, plane in zip(range(self.levels - 1, -1, -1), self.planes):
            ones = plane.ones(at)
            at = np.where(number >> shift & 1 == 1, plane.zeros + ones, at - ones)
        return at


class FmIndex:
    """Sequences of numbers from 1 on, of at most ``threshold`` words to be told apart; ``owner`` numbers may be kept per sequence.

    ``sequences`` are joined with a 0 behind each. A number that occurs
    nowhere matches nothing.
    """

    def __init__(self, numbers: np.ndarray, sizes: np.ndarray, threshold: int):
        self.threshold = threshold
        ends = np.cumsum(sizes)
        self.text = np.insert(numbers, ends, 0).astype(np.int64)
        n = self.size = len(self.text)
        self.sequence = np.repeat(np.arange(len(sizes)), sizes + 1)
        order, ranks = self._sorted(n)
        self.suffix = order
        self.most = int(self.text.max()) if n else 0
        self.counts = np.cumsum(np.bincount(self.text, minlength=self.most + 2)) if n else np.zeros(2, np.int64)
        self.bwt = Wavelet(self.text[order - 1], self.most)
        # Where the places of each number begin in the last order of the planes.
        self.first = self.bwt.rank(np.arange(self.most + 1), np.zeros(self.most + 1, np.int64))
        self.common = self._common(order, ranks)
        cut = np.flatnonzero(self.common[:-1] < threshold) if n else np.empty(0, np.int64)
        self.class_start = cut
        self.class_of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, n)))
        self._least: list[np.ndarray] | None = None

    def _sorted(self, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffixes in order of their first words, and the ranks of prefixes of 1, 2, 4, ... words."""
        rank, ranks, width = self.text, [], 1
        order = np.argsort(rank, kind="stable")
        while width <= self.threshold:
            ranks.append(rank.astype(np.int32))
            later = np.full(n, -1, np.int64)
            later[:max(0, n - width)] = rank[width:]
            key = rank * (n + self.text.max(initial=0) + 2) + later + 1
            order = np.argsort(key, kind="stable")
            step = np.concatenate(([0], key[order[1:]] != key[order[:-1]])) if n else np.empty(0, np.int64)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            width *= 2
        return order, ranks

    def _common(self, order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Words each suffix in order shares with the one before it, at most ``threshold``; 0 at both ends."""
        n = len(order)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(n - 1, 0), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            same = np.flatnonzero((np.maximum(a, b) < n) & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)]))
            # A rank of 2^k words tells suffixes cut short by the end from longer ones, so equal ranks are whole.
            common[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        return np.concatenate(([0], np.minimum(common, self.threshold), [0])).astype(np.uint8)

    def step(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one number put in front; empty where there are none."""
        known = (number > 0) & (number <= self.most)
        safe = np.where(known, number, 0)
        shift = np.where(known, self.counts[safe - 1] - self.first[safe], 0)
        low, high = self.bwt.rank(safe, low) + shift, self.bwt.rank(safe, high) + shift
        return np.where(known, low, 0), np.where(known, high, 0)

    def widened(self, low: np.ndarray, high: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``words`` words of what the given ones match, by halving over the least common prefixes."""
        if self._least is None:
            self._least = [self.common]
            while 2 << (len(self._least) - 1) <= len(self.common):
                row, half = self._least[-1], 1 << (len(self._least) - 1)
                self._least.append(np.minimum(row[:-half], row[half:]))
        low, high = low.copy(), high.copy()
        for k in range(len(self._least) - 1, -1, -1):
            row, width = self._least[k], 1 << k
            at = low - width + 1
            more = (at >= 0) & (row[np.maximum(at, 0)] >= words)
            low = np.where(more, low - width, low)
            at = np.minimum(high, len(row) - 1)
            more = (high + width <= len(self.common)) & (row[at] >= words)
            high = np.where(more, high + width, high)
        return low, high

    def matching_statistics(self, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per place of each streamed sequence the longest match that starts there, at most ``threshold`` words, and its interval.

        All sequences are read from their ends at once, one word a step.
        """
        total = len(numbers)
        length, lows, highs = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, self.size)
        if not total:
            return length, lows, highs
        by_size = np.argsort(-sizes, kind="stable")
        last = (np.cumsum(sizes) - 1)[by_size]
        ordered = sizes[by_size]
        low, high, size = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.size), np.zeros(len(sizes), np.int64)
        for t in range(int(ordered[0])):
            n = int(np.searchsorted(-ordered, -t, side="left"))
            at = last[:n] - t
            self._advance(numbers[at], low, high, size, n)
            length[at], lows[at], highs[at] = size[:n], low[:n], high[:n]
        return length, lows, highs

    def _advance(self, number: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, n: int) -> None:
        todo = np.arange(n)
        while len(todo):
            a, b = self.step(number[todo], low[todo], high[todo])
            hit = a < b
            done = todo[hit]
            low[done], high[done] = a[hit], b[hit]
            size[done] += 1
            todo = todo[~hit]
            # A match of no words that cannot grow is none; others give up words at their right end.
            none = todo[size[todo] == 0]
            low[none], high[none] = 0, self.size
            todo = todo[size[todo] > 0]
            if len(todo):
                shorter = np.maximum(self.common[low[todo]], self.common[high[todo]]).astype(np.int64)
                low[todo], high[todo] = self.widened(low[todo], high[todo], shorter)
                size[todo] = shorter
                low[todo[shorter == 0]], high[todo[shorter == 0]] = 0, self.size
        full = np.flatnonzero(size[:n] > self.threshold)
        if len(full):
            # The interval of the first ``threshold`` words is the class of suffixes that share as many.
            own = self.class_of[low[full]]
            low[full] = self.class_start[own]
            high[full] = np.append(self.class_start, self.size)[own + 1]
            size[full] = self.threshold

    def least_of_classes(self, of_sequence: np.ndarray) -> np.ndarray:
        """Least value of the sequences in each class of suffixes that share ``threshold`` words."""
        if not self.size:
            return np.empty(0, of_sequence.dtype)
        return np.minimum.reduceat(of_sequence[self.sequence[self.suffix]], self.class_start)

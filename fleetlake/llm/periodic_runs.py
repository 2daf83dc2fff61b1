"""Runs (maximal periodic stretches) in the words of a text, by Baier's grouping.

A run has a Lyndon root under the order of the words or under its reverse, and
that root is the longest Lyndon word from its place. The first phase of
Baier's suffix sorter puts every suffix into the group of just that word, so
the lengths of the groups are the Lyndon array: one phase per order gives the
roots, and the longest common extensions to both sides make them runs.

Every word of a run of twelve words and more lies in six words that occur
again within it. Only stretches of such words are grouped; all others hold no run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import pieces_of, release, small_batches, values
from .hashing import mixed, run_hashes

LEAST = 12
#: Text bytes worked on at a time.
BLOCK_BYTES = 2_000_000


def lyndon_lengths(symbols: list[int], reverse: bool = False) -> list[int]:
    """Per place the length of the longest Lyndon word that starts there, under the order of the numbers or its reverse.

    Groups are stretches of one array, named by their first place there, so
    names are in the order of the groups. They are worked on from the highest
    down: a place that precedes members of the group, with nothing lower in
    between, takes them into its own word, and leaves its group for a new one
    right behind it (behind that of places that take fewer).
    """
    n = len(symbols)
    keys = np.array(symbols, np.int64)
    order = np.argsort(-keys if reverse else keys, kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    first = np.flatnonzero(new)
    names = np.repeat(first, np.diff(np.append(first, n)))
    group_of, place_of = np.empty(n, np.int64), np.empty(n, np.int64)
    group_of[order], place_of[order] = names, np.arange(n)
    members, group, place = order.tolist(), group_of.tolist(), place_of.tolist()
    length, stop, before = [1] * n, [0] * n, [-1] * n
    for a, b in zip(first.tolist(), [*first[1:].tolist(), n]):
        stop[a] = b

    def to_back(j: int, end: int) -> None:
        """Swap a place to the last seat of its group."""
        at, other = place[j], members[end]
        members[at], members[end] = other, j
        place[other], place[j] = at, end

    top = n
    while top:
        name = group[members[top - 1]]
        size = length[name]
        if top - name == 1:
            i = members[name]
            j = i - 1
            while j >= 0 and group[j] >= name:
                j = before[j]
            before[i] = j
            if j >= 0:
                own = group[j]
                end = stop[own] - 1
                if end == own:
                    length[own] += size
                else:
                    to_back(j, end)
                    stop[own] = group[j] = end
                    stop[end], length[end] = end + 1, length[own] + size
            top = name
            continue
        taken: dict[int, int] = {}
        for i in sorted(members[name:top]):
            j = i - 1
            while j >= 0 and group[j] >= name:
                j = before[j]
            before[i] = j
            if j >= 0:
                taken[j] = taken.get(j, 0) + 1
        # Places that take the most go furthest back.
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in taken.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for (times, own), places in sorted(moves.items()):
            end = stop[own]
            longer = length[own] - times * size
            start = end - len(places)
            if start == own:
                length[own] = longer
                continue
            for k, j in enumerate(places, 1):
                to_back(j, end - k)
                group[j] = start
            stop[own], stop[start], length[start] = start, end, longer
        top = name
    return [length[g] for g in group]


def _stretches(words: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of the stretches that may hold runs: words in windows of half the length that occur again.

    What repeats outside of its stretch is left out in a second look.
    """
    half = -(-least // 2)
    inside, owner = np.ones(len(words), bool), text
    grams = run_hashes(words, half)
    first = last = np.empty(0, np.int64)
    for _ in range(2):
        key = mixed(grams ^ mixed(owner[:len(grams)].astype(np.uint64)))
        at = np.flatnonzero((owner[:len(grams)] == owner[half - 1:]) & inside[:len(grams)] & inside[half - 1:])
        order = at[np.argsort(key[at])]
        same = key[order[1:]] == key[order[:-1]]
        again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + half, -1)
        inside = np.cumsum(edge[:-1]) > 0
        turn = np.ones(len(words) + 1, bool)
        turn[1:-1] = (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])
        cuts = np.flatnonzero(turn)
        keep = inside[cuts[:-1]] & (np.diff(cuts) >= least) if len(words) else np.empty(0, bool)
        first, last = cuts[:-1][keep], cuts[1:][keep]
        owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        marks = np.zeros(len(words) + 1, np.int64)
        marks[first] += 1
        marks[last] -= 1
        inside = np.cumsum(marks[:-1]) > 0
    return first, last


def _extension(sums: np.ndarray, powers: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How far the words at ``a`` and at ``b`` agree, to the right (step 1) or to the left of them (step -1), by halving on hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()

    def part(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        start = at if step > 0 else at - n
        return sums[start + n] - sums[start] * powers[n]

    while (todo := np.flatnonzero(low < high)).size:
        n = (low[todo] + high[todo] + 1) // 2
        same = part(a[todo], n) == part(b[todo], n)
        low[todo] = np.where(same, n, low[todo])
        high[todo] = np.where(same, high[todo], n - 1)
    return low


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes, and the powers of their base."""
    base = 0x9E3779B97F4A7C15
    powers = np.full(len(words) + 1, base, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    # h[i + 1] = h[i] * base + word, as a running sum of words times inverse powers.
    inverse = np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    values = mixed(words.astype(np.uint64) + np.uint64(1))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * inverse[1:])))
    return sums * powers, powers


def runs_of(words: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of at least ``least`` words, in ascending order; ``text`` numbers the texts in a row.

    Extensions are found by hashes, which never miss an agreement; each run is
    then compared word by word, and what a hash took for equal in error is extended by steps.
    """
    first, last = _stretches(words, text, least)
    at, period = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in zip(first.tolist(), last.tolist()):
        symbols = words[a:b].tolist()
        for reverse in (False, True):
            p = np.array(lyndon_lengths(symbols, reverse), np.int64)
            fits = np.flatnonzero(2 * p <= b - a)
            at.append(fits + a)
            period.append(p[fits])
            left.append(np.full(len(fits), a))
            right.append(np.full(len(fits), b))
    at, p, left, right = (np.concatenate(x) for x in (at, period, left, right))
    if not len(at):
        return at, at, p
    sums, powers = _sums(words)
    fits = at + p <= right
    at, p, left, right = at[fits], p[fits], left[fits], right[fits]
    after = _extension(sums, powers, at, at + p, right - at - p, 1)
    ahead = _extension(sums, powers, at, at + p, at - left, -1)
    good = (after + ahead >= p) & (after + ahead + p >= least)
    start, end, p, left, right = (at - ahead)[good], (at + p + after)[good], p[good], left[good], right[good]
    _, pick = np.unique(np.stack([start, p, end]), axis=1, return_index=True)
    found, wrong = set(), set()
    for i in pick.tolist():
        s, e, q = int(start[i]), int(end[i]), int(p[i])
        if np.array_equal(words[s:e - q], words[s + q:e]):
            found.add((s, e - s, q))
        else:
            wrong.add((int(left[i]), int(right[i]), q))
    for stretch in wrong:
        found |= _stepwise(words, *stretch, least)
    rows = sorted((s, q, n) for s, n, q in found)
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 2], table[:, 1]


def _stepwise(words: np.ndarray, left: int, right: int, q: int, least: int) -> set[tuple[int, int, int]]:
    """Runs of a period between two places, word by word."""
    same = np.concatenate(([False], words[left:right - q] == words[left + q:right], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    stretches = zip(edges[::2].tolist(), edges[1::2].tolist())
    out = set()
    for a, b in stretches:
        n = b - a + q
        if n >= max(least, 2 * q) and not any(
                q % d == 0 and np.array_equal(words[left + a:left + a + n - d], words[left + a + d:left + a + n]) for d in range(1, q)):
            out.add((left + a, n, q))
    return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_FOUND = [
    ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
    edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, with_text: bool = True,
) -> DataFrame:
    """Per row its runs, the longest of them, and the text with each run collapsed to its first period.

    Columns ``(id_col, n_words, n_runs, start, length, period, exponent_milli,
    runs_sha256, collapsed_sha256)``, with ``with_text`` also ``runs`` (by start,
    then period) and ``collapsed`` (kept words joined by one blank). Words are what
    stands between blanks and the controls 9 to 13; ``edit`` may change a row's
    words first. A run has at least ``least`` words and twice its smallest period.

    Each row is worked on by itself: null and empty texts have no words and no
    run (null figures), repeated rows and null identifiers are rows like others,
    other columns are not read, and a table without rows gives none. A text must
    fit the memory of a task some 30 times over where all of it repeats.
    """
    kind = docs.schema[id_col].dataType
    extra = [T.StructField("runs", _RUN), T.StructField("collapsed", T.BinaryType())] if with_text else []
    out = T.StructType([T.StructField("_id", kind)] + [
        T.StructField(n, T.StringType() if t == pa.string() else T.LongType()) for n, t in _FOUND] + extra)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text", BLOCK_BYTES):
                yield _block(batch, least, edit, with_text)
        release()

    rows = small_batches(docs).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(work, out).withColumnRenamed("_id", id_col)


def _block(batch: pa.RecordBatch, least: int, edit: Callable | None, with_text: bool) -> pa.RecordBatch:
    numbers, parts = _Numbers(), []
    for doc_id, text in zip(values(batch.column("_id")), values(batch.column("text"))):
        own = text.split()
        own = edit(doc_id, own) if edit else own
        parts.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
    spelt = list(numbers)
    sizes = np.array([len(x) for x in parts], np.int64)
    words = np.concatenate([np.empty(0, np.int64), *parts])
    ends = np.cumsum(sizes)
    start, length, period = runs_of(words, np.repeat(np.arange(len(sizes)), sizes), least)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    kept = np.cumsum(gone[:-1]) == 0
    cuts = np.searchsorted(start, np.concatenate(([0], ends)))
    columns: list[list] = [[] for _ in range(len(_FOUND) + 2 * with_text)]
    for k, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
        a, b = int(cuts[k]), int(cuts[k + 1])
        runs = list(zip((start[a:b] - (end - n)).tolist(), length[a:b].tolist(), period[a:b].tolist()))
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        s, m, q = best or (None, None, None)
        text = b" ".join([spelt[w] for w in words[end - n:end][kept[end - n:end]].tolist()])
        digest = hashlib.sha256("".join([f"{x},{y},{z}\n" for x, y, z in runs]).encode()).hexdigest()
        row = (n, len(runs), s, m, q, best and 1000 * m // q, digest, hashlib.sha256(text).hexdigest())
        if with_text:
            row += ([{"start": x, "length": y, "period": z} for x, y, z in runs], text)
        for column, value in zip(columns, row):
            column.append(value)
    types = [t for _, t in _FOUND]
    names = [n for n, _ in _FOUND]
    if with_text:
        fields = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        types, names = [*types, pa.list_(fields), pa.binary()], [*names, "runs", "collapsed"]
    return pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["_id", *names])


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, told by the checksum of their identifier, made periodic from some word on."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]

"""Packing of documents into sequences by a configuration linear program.

A configuration says how many pieces of which lengths share a sequence. The
program over the length histogram (least total of configurations that cover
every length's count) is solved by multiplicative weights: lengths still short
of cover weigh more, and a knapsack dynamic program prices the configuration
worth most. The fractions are rounded down, room left in a sequence is filled
by the best fitting pieces, and what is left over is packed best fit. All of
this works on the histogram, whose size the sequence length bounds; pieces
then find their place by their number within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import MEMORY, Encoder, encoder
from .frames import cut_lineage, pieces_of, small_batches

CAPACITY = 2048
#: Classes of neighbouring lengths that are the rows of the program, and rounds of weights.
CLASSES = 512
ROUNDS = 400
STEP = 0.25
#: Pieces under this share of a sequence are kept out of the program and fill gaps.
SAND = 1 / 32
#: Tokens a rounded sequence may leave free; its pieces are otherwise packed with what is left over.
SLACK = 0


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size (ascending, any number) of the set worth most within ``capacity``."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        k = fitting[w]
        if k:
            value = best[w - sizes[:k]] + worth[:k]
            i = int(value.argmax())
            if value[i] > best[w - 1]:
                best[w], choice[w] = value[i], i
                continue
        best[w] = best[w - 1]
    count, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            count[choice[w]] += 1
            w -= int(sizes[choice[w]])
    return count


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations and their fractions by multiplicative weights; the fractions cover at most the demand."""
    covered, found = np.zeros(len(sizes)), {}
    for _ in range(rounds):
        short = covered / demand
        weight = np.exp(-12 * np.minimum(short, 1)) / demand
        # The length itself counts too, so that full configurations are preferred at equal weights.
        weight = weight / (weight * demand).sum() + sizes / (sizes * demand).sum()
        weight[short >= 1] = 0
        if not weight.any():
            break
        use = knapsack(sizes, weight, capacity)
        some = use > 0
        step = min(float((STEP * demand[some] / use[some]).min()), float(((demand - covered)[some] / use[some]).min()))
        covered += step * use
        key = use.tobytes()
        found[key] = (use, found.get(key, (use, 0.0))[1] + step)
    return list(found.values())


class _Rest:
    """Pieces not yet placed, by length."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def longest(self, room: int) -> int:
        """The longest length left within ``room``, 0 if there is none."""
        found = np.flatnonzero(self.counts[1:room + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def fill(self, config: list[int], copies: int, slack: int) -> list[tuple[list[int], int]]:
        """Take the best fitting pieces into the room left; sequences with more than ``slack`` still free are given up."""
        done, work = [], [(config, copies, len(self.counts) - 1 - sum(config))]
        while work:
            config, copies, room = work.pop()
            n = self.longest(room)
            if n:
                most = min(copies, int(self.counts[n]))
                self.counts[n] -= most
                work.append((config + [n], most, room - n))
                if copies > most:
                    work.append((config, copies - most, room))
            elif room <= slack:
                done.append((config, copies))
            else:
                for n in config:
                    self.counts[n] += copies
        return done


def best_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over a histogram; equal sequences are filled together."""
    capacity = len(counts) - 1
    rooms: dict[int, list[tuple[list[int], int]]] = {}
    open_rooms = np.zeros(capacity + 1, bool)
    for n in np.flatnonzero(counts)[::-1].tolist():
        k = int(counts[n])
        while k:
            at = np.flatnonzero(open_rooms[n:])
            if len(at):
                room = int(at[0]) + n
                config, copies = rooms[room].pop()
                if copies > k:
                    rooms[room].append((config, copies - k))
                open_rooms[room] = bool(rooms[room])
                most = min(k, copies)
            else:
                # As many new sequences as hold the rest of this length, each as full as it gets.
                per = min(capacity // n, k)
                config, room, most = [n] * (per - 1), capacity - n * (per - 1), k // per
                k -= most * (per - 1)
            rooms.setdefault(room - n, []).append((config + [n], most))
            open_rooms[room - n] = True
            k -= most
    return [run for runs in rooms.values() for run in runs]


def _concrete(use: np.ndarray, copies: int, queues: list[list[int]], rest: np.ndarray) -> Iterator[tuple[list[int], int]]:
    """Sequences of one configuration with lengths for its classes, longest first; a run ends where a length is used up."""
    slots = [c for c in np.flatnonzero(use)[::-1] for _ in range(use[c])]
    while copies:
        taken: dict[int, int] = {}
        for c in slots:
            n = next((n for n in queues[c] if rest[n] > taken.get(n, 0)), 0)
            if n:
                taken[n] = taken.get(n, 0) + 1
        if not taken:
            return
        most = min(copies, *(int(rest[n]) // k for n, k in taken.items()))
        for n, k in taken.items():
            rest[n] -= most * k
        yield [n for n, k in taken.items() for _ in range(k)], most
        copies -= most


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Configurations as lists of lengths, and how many sequences follow each."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        counts[n] += k
    lengths = np.flatnonzero(counts)
    lengths = lengths[(lengths > SAND * capacity) & (lengths < capacity)]
    rounded = []
    if len(lengths):
        dense = np.repeat(lengths, np.maximum(1, counts[lengths] * 10_000 // counts[lengths].sum()))
        sizes = np.unique(np.quantile(dense, np.linspace(0, 1, CLASSES + 1)[1:], method="higher"))
        of = np.searchsorted(sizes, lengths)
        queues = [[int(n) for n in lengths[of == c][::-1]] for c in range(len(sizes))]
        for use, fraction in solve(sizes, np.bincount(of, counts[lengths]), capacity):
            rounded += _concrete(use, int(fraction), queues, counts)
    rest = _Rest(counts)
    # The fullest come first, so that gap fillers close as many sequences as they can.
    full = [run for config, copies in sorted(rounded, key=lambda r: -sum(r[0])) for run in rest.fill(config, copies, SLACK)]
    return full + best_fit(counts)


def places(configs: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Per length and run of piece numbers: ``length, first number, first sequence, offset``, sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for config, copies in configs:
        offset = 0
        for n in config:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + copies
            offset += n
        sequence += copies
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


PIECES = "id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, block int, number bigint"


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0, memory: int = MEMORY) -> DataFrame:
    """Token pieces of at most ``capacity`` ids, numbered per length within the task (``block``) that made them."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary, memory) as known:
            yield from encoded(known, batches)

    def encoded(known: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, numbers = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in pieces_of(whole, "text", 4_000_000):
                ids, sizes = known.encode(batch.column("text").to_pylist(), end)
                data, first = ids.astype("<u4"), np.cumsum(sizes) - sizes
                parts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = first[row] + start
                crc = [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                values, begin, many = np.unique(length[order], return_index=True, return_counts=True)
                number = np.empty(len(row), np.int64)
                number[order] = np.arange(len(row)) - np.repeat(begin - numbers[values], many)
                numbers[values] += many
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(row), block, np.int32)), pa.array(number),
                ], names=["id", "piece", "start", "length", "ids_crc32", "block", "number"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES.format(id=kind))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0, memory: int = MEMORY) -> DataFrame:
    """One row per piece: where it comes from and its ``sequence_id`` and ``offset``.

    The pieces (no ids) are written once. Their numbers within a length are
    made gapless over all tasks by the counts per task and length; then the
    plan's runs, whose number the capacity bounds, give the place. Null and
    empty texts are one piece of the end id; repeated rows are packed each,
    an empty table gives no rows.
    """
    cut = cut_lineage(pieces(docs, vocabulary, id_col, text_col, capacity, end, memory))
    counts = cut_lineage(cut.groupBy("block", "length").agg(F.count("*").alias("n")))
    before = cut_lineage(counts.select(
        "block", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = places(plan(histogram, capacity))

    @F.arrow_udf("sequence_id bigint, offset bigint")
    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        length, first, sequence, offset = runs
        n, k = lengths.to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False)
        at = np.searchsorted(length * (1 << 44) + first, n * (1 << 44) + k, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence[at] + k - first[at]), pa.array(offset[at])], names=["sequence_id", "offset"])

    numbered = cut.join(before, ["block", "length"]).withColumn("at", place("length", F.col("number") + F.col("before")))
    return numbered.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")

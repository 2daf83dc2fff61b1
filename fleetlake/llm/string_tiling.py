"""Benchmark decontamination by greedy string tiling.

Words shared in a row with a test item are seeds; where the seeds could cover
enough of the item, running Karp-Rabin matching marks the longest common runs
first, without overlap, until none of ``least`` words is left. A document is
contaminated if its tiles cover a given share of an item, in whatever order
the passages stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import release, small_batches, values
from .hashing import run_hashes

LEAST = 5
COVERAGE = 0.5
#: Characters of test items that are sent to the tasks at once; more items are taken in several blocks.
BLOCK_CHARS = 16_000_000
_WORD = re.compile(r"\w+")


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(place in text, place in item, words)``, longest first. Negative ids match nothing."""
    free_text, free_item = text >= 0, item >= 0
    tiles, n = [], max(least, len(item))

    def open_runs(free: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) < n:
            return np.empty(0, int), np.empty(0, np.uint64)
        closed = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(closed[n:] == closed[:-n])
        return at, run_hashes(ids, n)[at]

    while True:
        at_text, hash_text = open_runs(free_text, text)
        at_item, hash_item = open_runs(free_item, item)
        order = np.argsort(hash_text, kind="stable")
        first = np.searchsorted(hash_text[order], hash_item)
        last = np.searchsorted(hash_text[order], hash_item, side="right")
        found = []
        for j, a, b in zip(at_item.tolist(), first.tolist(), last.tolist()):
            for i in at_text[order[a:b]].tolist():
                if i and j and free_text[i - 1] and free_item[j - 1] and text[i - 1] == item[j - 1]:
                    continue  # a longer run starts one word earlier
                most = min(len(text) - i, len(item) - j)
                same = (text[i:i + most] == item[j:j + most]) & free_text[i:i + most] & free_item[j:j + most]
                size = most if same.all() else int(same.argmin())
                if size >= n:
                    found.append((-size, i, j))
        marked = False
        for size, i, j in sorted(found):
            if free_text[i:i - size].all() and free_item[j:j - size].all():
                free_text[i:i - size] = free_item[j:j - size] = False
                tiles.append((i, j, -size))
                marked = True
        # What a marked run has cut is looked for again at the same length.
        if not marked or not found:
            if n == least:
                return tiles
            n = max(least, n // 2)


class Items:
    """Test items as arrays of word numbers, with the seeds of all of them; an item of fewer words than a seed is one seed."""

    def __init__(self, texts: list[str | None], least: int):
        self.least, self.number = least, {}
        self.words = [
            np.array([self.number.setdefault(w, len(self.number)) for w in _WORD.findall((t or "").lower())], np.int64) for t in texts]
        self.seeds = {}
        for n in sorted({min(least, len(w)) for w in self.words} - {0}):
            own = [k for k, w in enumerate(self.words) if min(least, len(w)) == n]
            hashes = [run_hashes(self.words[k], n) for k in own]
            seeds = np.concatenate(hashes)
            item = np.repeat(own, [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            order = np.argsort(seeds, kind="stable")
            self.seeds[n] = seeds[order], item[order], place[order]

    def matches(self, text: str | None, coverage: float) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        """``(item, words covered, tiles)`` for every item whose tiles cover the share ``coverage``.

        A seed counts once however often the text has it, and only items that
        the text's seeds could cover are tiled.
        """
        words, out = _WORD.findall((text or "").lower()), []
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words)) if self.seeds else np.empty(0, np.int64)
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        for n, (seeds, items, places) in self.seeds.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = run_hashes(ids, n)[at]
            distinct = np.unique(h)
            first = np.searchsorted(seeds, distinct)
            many = np.searchsorted(seeds, distinct, side="right") - first
            pair = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            pair = pair[np.lexsort((places[pair], items[pair]))]
            item, place = items[pair], places[pair]
            # Words of an item that its shared seeds cover: each up to the next seed.
            last = np.append(item[1:] != item[:-1], True)
            reach = np.where(last, n, np.minimum(n, np.append(place[1:], 0) - place))
            begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(item)), bool), item[1:] != item[:-1])))
            covered = np.add.reduceat(reach, begin) if len(begin) else begin
            ends = np.append(begin[1:], len(item))
            for a, b, seen in zip(begin.tolist(), ends.tolist(), covered.tolist()):
                k = int(item[a])
                size = len(self.words[k])
                # Tiles cover no more of the item than its seeds do.
                if seen < coverage * size:
                    continue
                near = np.zeros(len(ids), bool)
                mine = at[np.isin(h, seeds[pair[a:b]])]
                for i in range(n):
                    near[mine + i] = True
                tiles = tile(np.where(near, ids, -1), self.words[k], n)
                total = sum(t[2] for t in tiles)
                if total and total >= coverage * size:
                    out.append((k, total, tiles))
        return sorted(out)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """The items, collected block by block; the number of blocks follows their total length."""
    items = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()


def _matched(items: list, kind: T.DataType, least: int, coverage: float, text: Column) -> Column:
    """An array of (item_id, item_words, covered, tiles) for a text column and one block of items."""
    known, names = Items([r.text for r in items], least), [r.id for r in items]
    tiles = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("word", "item_word", "words")]))
    row = T.StructType([
        T.StructField("item_id", kind), T.StructField("item_words", T.LongType()), T.StructField("covered", T.LongType()),
        T.StructField("tiles", tiles)])

    @F.arrow_udf(T.ArrayType(row))
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        arrow = to_arrow_type(T.ArrayType(row))
        for texts in batches:
            yield pa.array([
                [{"item_id": names[k], "item_words": len(known.words[k]), "covered": covered,
                  "tiles": [dict(zip(("word", "item_word", "words"), t)) for t in tiles]}
                 for k, covered, tiles in known.matches(text, coverage)] for text in values(texts)], arrow)
        release()

    return matched(text)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """One row ``(id, item_id, item_words, covered, coverage, n_tiles, tiles)`` per document and item it contaminates.

    Words are runs of letters, digits and underscores in lower case. Documents
    are never shuffled. Null and empty texts match nothing; an item of fewer
    than ``least`` words matches where all of it stands in a row. Repeated rows
    give repeated results, empty tables none.
    """
    kind = items.schema[item_col].dataType
    found = None
    for block in _blocks(items, item_col, item_text_col):
        part = small_batches(docs).select(F.col(id_col).alias(id_col), F.explode(_matched(block, kind, least, coverage, F.col(text_col))).alias("m"))
        found = part if found is None else found.union(part)
    return found.select(
        F.col(id_col), "m.item_id", "m.item_words", "m.covered", (F.col("m.covered") / F.col("m.item_words")).alias("coverage"),
        F.size("m.tiles").cast("bigint").alias("n_tiles"), "m.tiles")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The documents that cover no item, with their columns as they are."""
    kind = items.schema[item_col].dataType
    for block in _blocks(items, item_col, item_text_col):
        docs = small_batches(docs).where(F.size(_matched(block, kind, least, coverage, F.col(text_col))) == 0)
    return docs

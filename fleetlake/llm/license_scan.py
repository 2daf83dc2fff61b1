"""Licence scan by conditional compression.

Sentences with a cue, and the sentences around them made of licence words, are
candidate blocks. A block is compressed by itself and once more with each
template as a raw zstandard dictionary; the template that saves the largest
share knows most of the block. Those that save enough are compared with
the block word by word, and the one with the fewest differences wins if they
are few and touch no number or name. If none does, a notice may stand among
other words: each template is tried on the words around every cue, where its
saving is set against its own size. What is left of a block beside a winner
is scanned in the same way.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import small_batches, values
from .licenses import TEMPLATES

_CUES = ("licen", "copyright", "rights reserved", "permission", "redistribut", "creative commons", "unencumbered")
_CUE = re.compile("|".join(_CUES), re.I)
_SENTENCE = re.compile(r"\S.*?(?:[.!?:;](?=\s)|$)", re.M)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_MARKS = re.compile(r"[.:;!?)\"']*")
#: Words that tell licences apart: a notice without one of them, or with one more, is another.
_NAMES = frozenset("lesser affero mit isc bsd apache mozilla eclipse boost".split())
#: Least share of a block a template must save, and of its words that must be there.
SAVED = 0.25
MATCHED = 0.85
#: A sentence beside a cue belongs to the block if so many of its words are licence words.
VOCABULARY = 0.8


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Templates:
    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        self.words = [words(t) for _, t in templates]
        self.vocabulary = {w for t in self.words for w in t}
        frame = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**frame)
        self.given = []
        for _, t in templates:
            known = zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append(zstandard.ZstdCompressor(dict_data=known, **frame))
        self.empty = len(self.plain.compress(b""))
        self.alone = [max(len(self.plain.compress(t.lower().encode())) - self.empty, 1) for _, t in templates]
        self.match = lru_cache(maxsize=10_000)(self._match)
        self.near = lru_cache(maxsize=100_000)(self._near)

    def savings(self, block: str) -> list[tuple[float, int]]:
        """``(share saved, template)``, largest first; case and the frame's own bytes don't count."""
        data = block.lower().encode()
        alone = max(len(self.plain.compress(data)) - self.empty, 1)
        shares = [1 - max(len(c.compress(data)) - self.empty, 0) / alone for c in self.given]
        return sorted(((s, k) for k, s in enumerate(shares)), key=lambda x: (-x[0], x[1]))

    def differences(self, block: str, template: int) -> tuple[float, list[str], int, int]:
        """Share of the template's words found in order, the words missing (-) and put in between (+), and where they stand."""
        want, places = self.words[template], list(_WORD.finditer(block))
        have = [m[0].lower() for m in places]
        same = [m for m in SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return 0.0, [f"-{w}" for w in want], 0, 0
        found = {i for m in same for i in range(m.a, m.a + m.size)}
        inside = {j for m in same for j in range(m.b, m.b + m.size)}
        extra = [have[j] for j in range(same[0].b, same[-1].b + same[-1].size) if j not in inside]
        start, end = places[same[0].b].start(), places[same[-1].b + same[-1].size - 1].end()
        end = _MARKS.match(block, end).end()
        return len(found) / len(want), [f"-{w}" for i, w in enumerate(want) if i not in found] + [f"+{w}" for w in extra], start, end

    def _match(self, block: str) -> tuple[str, float, int, list[str], int, int] | None:
        """``(licence, share saved, words, differences, start, end)`` of the winner."""
        best = None
        for saved, k in self.savings(block):
            if saved < SAVED:
                break
            differ, start, end = self.confirmed(block, k) or (None, 0, 0)
            if differ is not None and (best is None or (len(differ), -len(self.words[k])) < (len(best[3]), -best[2])):
                best = (self.names[k], saved, len(self.words[k]), differ, start, end)
        return best

    def confirmed(self, block: str, k: int) -> tuple[list[str], int, int] | None:
        """Differences and place of a template, if they are few and touch no number or name."""
        share, differ, start, end = self.differences(block, k)
        exact = not any(c.isdigit() for w in differ for c in w) and not any("-" in w[1:] or w[1:] in _NAMES for w in differ)
        few = sum(w[0] == "+" for w in differ) <= (1 - MATCHED) * len(self.words[k])
        return (differ, start, end) if share >= MATCHED and exact and few else None

    def _near(self, window: str, k: int) -> tuple[float, list[str], int, int] | None:
        """``(share of the template saved, differences, start, end)`` of a template among other words."""
        data = window.lower().encode()
        saved = len(self.plain.compress(data)) - len(self.given[k].compress(data))
        if saved < SAVED * self.alone[k]:
            return None
        # Only the words around the longest common run, so that stray words of the template further away don't count.
        want, places = self.words[k], list(_WORD.finditer(window))
        m = SequenceMatcher(None, want, [p[0].lower() for p in places], autojunk=False).find_longest_match()
        if not m.size:
            return None
        room = int((1 - MATCHED) * len(want))
        first, last = max(m.b - m.a - room, 0), min(m.b + len(want) - m.a + room, len(places))
        a = places[first].start()
        found = self.confirmed(window[a:places[last].start() if last < len(places) else len(window)], k)
        return found and (saved / self.alone[k], found[0], a + found[1], a + found[2])

    def embedded(self, block: str) -> tuple[str, float, int, list[str], int, int] | None:
        """As ``match``, of the best notice among other words: fewest differences, then most words, then first."""
        places = list(_WORD.finditer(block))
        starts = [p.start() for p in places]
        cues = sorted({max(bisect_right(starts, m.start()) - 1, 0) for m in _CUE.finditer(block)})
        best, order = None, None
        for k, want in enumerate(self.words):
            reach, done = len(want) + int((1 - MATCHED) * len(want)) + 1, -1
            for c in cues:
                # Windows overlap by more than a notice, so cues close to one already tried are passed over.
                if c < done:
                    continue
                a, last = max(c - reach, 0), min(c + 2 * reach, len(places) - 1)
                done = c + reach
                found = self.near(block[starts[a]:starts[last + 1] if last + 1 < len(places) else len(block)], k)
                if found and (best is None or (len(found[1]), -len(want), starts[a] + found[2]) < order):
                    order = len(found[1]), -len(want), starts[a] + found[2]
                    best = self.names[k], found[0], len(want), found[1], starts[a] + found[2], starts[a] + found[3]
        return best

    def blocks(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, block)`` in code points: each sentence with a cue, then runs of licence sentences around it, and of its wrapped lines."""
        low = text.lower()
        if not any(c in low for c in _CUES):
            return []
        spans = [(m.start(), m.end()) for m in _SENTENCE.finditer(text)]
        wraps = [text[b - 1] not in ".!?:;" and text.count("\n", b, c) <= 1 for (_, b), (c, _) in zip(spans, spans[1:])]
        out, done, lined = [], -1, -1
        for i, (a, b) in enumerate(spans):
            if not any(c in low[a:b] for c in _CUES):
                continue
            out.append((a, b, text[a:b]))
            first = last = i
            while first > 0 and self._speaks(text[spans[first - 1][0]:spans[first - 1][1]]):
                first -= 1
            while last + 1 < len(spans) and self._speaks(text[spans[last + 1][0]:spans[last + 1][1]]):
                last += 1
            if last > first and first > done:
                out.append((spans[first][0], spans[last][1], text[spans[first][0]:spans[last][1]]))
                done = last
            first = last = i
            while i > lined and first > 0 and wraps[first - 1]:
                first -= 1
            while i > lined and last < len(wraps) and wraps[last]:
                last += 1
            if last > first:
                out.append((spans[first][0], spans[last][1], text[spans[first][0]:spans[last][1]]))
                lined = last
        return out

    def _speaks(self, sentence: str) -> bool:
        w = words(sentence)
        return bool(w) and sum(x in self.vocabulary for x in w) >= VOCABULARY * len(w)

    def scan(self, text: str | None) -> list[dict]:
        """The licences of a text, each from its first to its last word; one inside another of the same licence is left out."""
        found = []
        for start, end, _ in self.blocks(text or ""):
            left = [(start, end)]
            while left:
                a, b = left.pop()
                part = text[a:b]
                won = _CUE.search(part) and (self.match(part) or self.embedded(part))
                if won:
                    found.append({"license": won[0], "start": a + won[4], "end": a + won[5], "saved": won[1], "n_words": won[2], "differences": won[3]})
                    left += [(a, a + won[4]), (a + won[5], b)]
        found.sort(key=lambda f: (f["start"], -f["end"]))
        kept: list[dict] = []
        for f in found:
            # The opening of a BSD licence counts by itself only where no clauses tell which it is.
            same = [k for k in kept if k["license"] == f["license"] or f["license"] == "LicenseRef-BSD" and k["license"].startswith("BSD-")]
            if not any(k["start"] <= f["start"] and f["end"] <= k["end"] for k in same):
                kept.append(f)
        return kept


@lru_cache(maxsize=4)
def _templates(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(list(templates))


_FOUND = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("saved", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("differences", T.ArrayType(T.StringType()))]))
_ARROW = pa.list_(pa.struct([
    ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("n_words", pa.int64()),
    ("differences", pa.list_(pa.string()))]))


def licenses_of(text: Column, templates: list[tuple[str, str]] = TEMPLATES) -> Column:
    """The licences of a text column as an array; null and empty texts have none."""
    given = tuple(templates)

    @F.arrow_udf(_FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _templates(given)
        for texts in batches:
            yield pa.array([known.scan(t) for t in values(texts)], _ARROW)

    return found(text)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row ``(id_col, license, start, end, saved, n_words, n_different, differences)`` per notice found.

    Places are code points, the end exclusive. Documents are never shuffled.
    Null identifiers are kept, repeated rows repeat, and texts without notices
    and empty tables give no rows.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.explode(licenses_of(F.col(text_col), templates)).alias("f")).select("id", "f.*")
    return rows.select(
        F.col("id").alias(id_col), "license", "start", "end", "saved", "n_words", F.size("differences").cast("bigint").alias("n_different"), "differences")

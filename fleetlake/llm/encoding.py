"""Token ids of texts with the tokenizers library, each distinct word encoded once per task.

Both vocabularies used here split a text before they merge, and never join
characters on either side of a boundary "no white space, then white space" or
"letter, then other". So a text is cut into words with the white space before
them, found again by a 64-bit hash and compared byte by byte, and new words
into runs of letters and of others; only runs not met before are encoded (runs
of letters, which are never split again, by the merges alone), and the ids of a
text are strung together. Words with an apostrophe or with characters beyond
ASCII and Latin-1 letters are encoded whole, as are texts with white space
beyond blank, tab and line ends, and texts with the string of a special token.
"""

from __future__ import annotations

import os
import re
from os.path import commonprefix
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np

from .frames import release
from .hashing import Table, mixed

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WHOLE = re.compile(rf"[^\x00-\x7f{_LETTER}]|'")
_PIECE = re.compile(rf"[ \t\r\n]*[{_LETTER}]+|[ \t\r\n]*[^ \t\r\n{_LETTER}]+|[ \t\r\n]+")
# Byte-level vocabularies spell a byte by its Latin-1 character if that is printable, the others by those from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELT = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
del _SPELT[0x0A]  # parts the runs while they are spelt
_BLANKS = ("", " ", "\t", "\r", "\n")
_RUN_OF_LETTERS = re.compile(rf" ?[{_LETTER}]+\Z")
#: Distinct words remembered before starting afresh (about 170 bytes each), and bytes of text worked on at a time.
MEMORY = 400_000
GROUP_BYTES = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0D, 0x20]] = True
# Bytes that odd white space is, or begins with.
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
# An odd factor and its inverse modulo 2 to the 64, and a number per byte.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n + 1, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Ids:
    """Ids (or bytes) of numbered strings in one array, far below 2 to the 31 of them."""

    def __init__(self, kind: type = np.uint32):
        self.ids, self.ends = np.empty(0, kind), np.zeros(1, np.int64)

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings in a row, and how many each has."""
        first = self.ends[numbers]
        n = self.ends[numbers + 1] - first
        ends = np.cumsum(n)
        at = np.repeat((first - (ends - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids.take(at), n


class _Numbers(dict):
    """Gives each new key the next number and notes it."""

    def __init__(self):
        self.new = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A string of a special token is one id wherever it stands.
        self.special, self.mark = re.compile("|".join(map(re.escape, special)) or "(?!)", re.I), commonprefix(special).encode()
        self.blanks_count = self._ids([" a"])[0] != self._ids(["a"])[0]
        self.lower = self._ids(["A", "Ä"]) == self._ids(["a", "ä"])
        self.merge, self.memory = self.tokenizer.model.tokenize, MEMORY
        self.powers = self.inverses = np.empty(0, np.uint64)
        self._forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.words, self.word_ids = Table(np.empty(0, np.uint64), np.empty(0, np.int64), -1), _Ids()
        self.spelt, self.clashes = _Ids(np.uint8), {}
        self.pieces, self.piece_ids = _Numbers(), _Ids()

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids(pieces)
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _merged(self, runs: list[str]) -> list[list[int]]:
        """Runs of letters go to the merges directly, spelt in the vocabulary's letters for bytes."""
        merge, out = self.merge, [None] * len(runs)
        plain = [k for k, r in enumerate(runs) if r.isascii()]
        other = [k for k, r in enumerate(runs) if not r.isascii()]
        spelt = "\n".join([runs[k] for k in plain]).replace(" ", chr(_SPELT[0x20])).split("\n")
        for k, run in zip(plain, spelt):
            out[k] = [t.id for t in merge(run)]
        spelt = "\n".join([runs[k] for k in other]).encode().decode("latin-1").translate(_SPELT).split("\n")
        for k, run in zip(other, spelt):
            out[k] = [t.id for t in merge(run)]
        return out

    def _learn_pieces(self) -> None:
        new, self.pieces.new = self.pieces.new, []
        if not self.blanks_count:
            new = [p.lstrip(" ") for p in new]
        found: list = [None] * len(new)
        runs = [k for k, p in enumerate(new) if _RUN_OF_LETTERS.match(p)]
        for k, ids in zip(runs, self._merged([new[k] for k in runs])):
            found[k] = ids
        rest = [k for k, ids in enumerate(found) if ids is None]
        for i in range(0, len(rest), 10_000):
            part = rest[i:i + 10_000]
            for k, ids in zip(part, self._ids([new[k] for k in part])):
                found[k] = ids
        self.piece_ids.append(np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _differ(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Which slices are not the words of these numbers: words of equal hash are told apart by their bytes."""
        first, stop = self.spelt.ends[numbers], self.spelt.ends[numbers + 1]
        wrong = stop - first != end - start
        same = np.flatnonzero(~wrong)
        held, _ = self.spelt.gather(numbers[same])
        size = end[same] - start[same]
        # Slices follow one another, so all of them are the data itself.
        own = data if len(same) == len(start) else data[np.repeat(~wrong, end - start)]
        at = np.flatnonzero(held != own)
        wrong[same[np.unique(np.searchsorted(np.cumsum(size), at, side="right"))]] = True
        return np.flatnonzero(wrong)

    def _clash(self, word: bytes) -> int:
        """The number of a word whose hash belongs to another one."""
        if word not in self.clashes:
            self.clashes[word] = len(self.word_ids.ends) - 1
            self._learn_words([word.decode()])
        return self.clashes[word]

    def _learn_words(self, new: list[str]) -> None:
        coded = [w.encode() for w in new]
        self.spelt.append(np.frombuffer(b"".join(coded), np.uint8), np.fromiter(map(len, coded), np.int64, len(coded)))
        # Words after one blank are cut together; every one of them starts with the only blank in it.
        plain = [i for i, w in enumerate(new) if w[0] == " " and w[1:2] not in _BLANKS]
        text = "".join([new[i] for i in plain])
        if _WHOLE.search(text) or _ODD.search(text) or self.special.search(text):
            plain = [i for i in plain if not _WHOLE.search(new[i]) and not _ODD.search(new[i]) and not self.special.search(new[i])]
            text = "".join([new[i] for i in plain])
        pieces = _PIECE.findall(text.lower() if self.lower else text)
        starts = np.fromiter((p[0] == " " for p in pieces), bool, len(pieces))
        sizes = np.diff(np.append(np.flatnonzero(starts), len(pieces)))
        seen, alone, counts = set(plain), [], []
        for i, word in enumerate(new):
            if i not in seen:
                own = [word] if _WHOLE.search(word) or _ODD.search(word) or self.special.search(word) else _PIECE.findall(word.lower() if self.lower else word)
                pieces += own
                alone.append(i)
                counts.append(len(own))
        numbers = self.pieces.of(pieces)
        if self.pieces.new:
            self._learn_pieces()
        ids, each = self.piece_ids.gather(numbers)
        ends = np.concatenate(([0], np.cumsum(each)))[np.cumsum(np.concatenate([sizes, np.array(counts, np.int64)]))]
        found, place = _Ids(), np.empty(len(new), np.int64)
        found.append(ids, np.diff(ends, prepend=0))
        place[plain + alone] = np.arange(len(new))
        self.word_ids.append(*found.gather(place))

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts with characters, and how many each has."""
        coded = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(coded), np.uint8)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        first = np.cumsum(sizes) - sizes
        space = _SPACE[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1]
        if _ODD_BYTE[data].any():
            for k in [k for k, t in enumerate(texts) if _ODD.search(t)]:
                cut[first[k]:first[k] + sizes[k]] = False
        joined = data.tobytes()
        if self.mark in joined:
            for k in [k for k, t in enumerate(texts) if self.special.search(t)]:
                cut[first[k]:first[k] + sizes[k]] = False
        cut[first] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        # The hash of a slice from running sums, brought to the same power wherever it stands.
        if len(self.powers) <= len(data):
            self.powers, self.inverses = (_powers(f, len(data) + GROUP_BYTES // 4) for f in (_FACTOR, _INVERSE))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * self.powers[:len(data)])))
        hashes = mixed((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))
        numbers = self.words.get(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, at, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[at]
            known = len(self.word_ids.ends) - 1 + np.arange(len(new))
            self._learn_words([joined[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist())])
            self.words.add(new, known)
            numbers[missing] = known[which]
        for i in self._differ(data, start, end, numbers).tolist():
            numbers[i] = self._clash(joined[start[i]:end[i]])
        ids, each = self.word_ids.gather(numbers)
        return ids, np.add.reduceat(each, np.searchsorted(start, first))

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the number of each; ``end`` is appended to every text. A null text is empty."""
        sizes, out = np.zeros(len(texts), np.int64), [np.empty(0, np.uint32)]
        full = [k for k, t in enumerate(texts) if t]
        i = 0
        while i < len(full):
            j, held = i, 0
            while j < len(full) and (j == i or held + len(texts[full[j]]) <= GROUP_BYTES):
                held += len(texts[full[j]])
                j += 1
            if self.words.used > self.memory:
                self._forget()
            ids, n = self._group([texts[k] for k in full[i:j]])
            out.append(ids)
            sizes[full[i:j]] = n
            i = j
        ids = np.concatenate(out)
        if end is None:
            return ids, sizes
        return np.insert(ids, np.cumsum(sizes), np.uint32(end)), sizes + 1


@lru_cache(maxsize=1)
def _loaded(path: str) -> Encoder:
    return Encoder(path)


@contextmanager
def encoder(path: str, memory: int = MEMORY, keep: bool = False) -> Iterator[Encoder]:
    """The worker's encoder. Workers outlive tasks: the words met are forgotten at the end, or kept for the next task."""
    loaded = _loaded(path)
    loaded.memory = memory
    try:
        yield loaded
    finally:
        if not keep:
            loaded._forget()
        release()

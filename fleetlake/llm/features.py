"""Counts of a text that quality rules and classifiers read; words are split at ASCII white space."""

from __future__ import annotations

import numpy as np

NAMES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks",
    "n_digits", "n_adjacent", "n_distinct", "n_bars", "longest_word", "n_points",
]
_SPACE = [0x20, *range(0x09, 0x0E)]
_SYMBOLS = list(b"#*$%&|<>")
_POINTS = list(b".,;:?'\"()-")


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if distinct < 2_000_000:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        _, pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)
        key = pair * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i:i + n] |= twice
    return int(covered.sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """The values of NAMES for one text; a null text counts as empty."""
    data = text or b""
    words = data.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen, lines, repeated = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            # An equal earlier line has a word as well.
            if line in seen:
                repeated += 1
            seen.add(line)
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = int(by.sum() - by[0x80:0xC0].sum())
    letters = int(by[0x41:0x5B].sum() + by[0x61:0x7B].sum() + by[0xC3:].sum())
    return (
        len(words), points - int(by[_SPACE].sum()), int(by[_SYMBOLS].sum()), repeated, repeat_words(ids, len(number)),
        lines, int(by[0x41:0x5B].sum()), letters, int(by[0x21]), int(by[0x30:0x3A].sum()),
        int((ids[1:] == ids[:-1]).sum()), len(number), int(by[0x7C]), max(map(len, words), default=0), int(by[_POINTS].sum()))

"""Probabilistic automata inferred from example strings (state merging on a prefix tree)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass


def symbols(value: str) -> list[str]:
    """Hexadecimal digits, g-z and A-Z are one symbol each, every other character is its own.

    With digits and a-f as one symbol the many random strings of a format share
    a path of the prefix tree, which keeps its length.
    """
    return ["hex" if c in "0123456789abcdef" else "g-z" if "g" <= c <= "z" else "A-Z" if "A" <= c <= "Z" else c for c in value]


@dataclass
class Automaton:
    """``steps[state][symbol] = (next state, log probability)``; ``ends[state]`` is the log probability to stop."""

    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]
    floors: list[float]
    shortest: int = 1

    def score(self, value: str) -> float:
        """Mean log likelihood of a symbol, the end counted as one. An unknown symbol keeps the state."""
        state, total, word = 0, 0.0, symbols(value)
        for s in word:
            step = self.steps[state].get(s)
            if step is None:
                total += self.floors[state]
            else:
                state, p = step
                total += p
        return (total + self.ends[state]) / (len(word) + 1)


#: Each character to the first of its symbol: a credential becomes the word all credentials of its symbols share.
ONE_EACH = ("123456789abcdefghijklmnopqrstuvwxyBCDEFGHIJKLMNOPQRSTUVWXYZ", "0" * 15 + "z" * 19 + "A" * 25)
_ONE_EACH = str.maketrans(*ONE_EACH)


def word_of(value: str) -> str:
    """The word of a value: same symbols, each written as one character."""
    return value.translate(_ONE_EACH)


class State:
    """A state of the tree; until it is opened it keeps the rest of its words as ``(word, place, number)``."""

    __slots__ = ("passed", "ended", "count", "to", "rest", "number")

    def __init__(self, rest: list[tuple[str, int, int]]):
        self.rest: list[tuple[str, int, int]] | None = rest
        self.passed = sum(n for _, _, n in rest)
        self.ended = sum(n for word, at, n in rest if at == len(word))
        self.number: int | None = None

    def open(self) -> State:
        if self.rest is not None:
            by_symbol: dict[str, list[tuple[str, int, int]]] = {}
            for word, at, n in self.rest:
                if at < len(word):
                    by_symbol.setdefault(word[at], []).append((word, at + 1, n))
            self.to = {s: State(rest) for s, rest in by_symbol.items()}
            self.count = {s: state.passed for s, state in self.to.items()}
            self.rest = None
        return self


def compatible(a: State, b: State, alpha: float) -> bool:
    """Hoeffding's test on the end and next-symbol frequencies of two states and of what follows both; ``b`` begins a tree."""
    width, stack = math.sqrt(0.5 * math.log(2 / alpha)), [(a, b)]
    while stack:
        x, y = stack.pop()
        if width / math.sqrt(y.passed) >= 1:
            continue  # no frequencies of so few words, or of what follows them, differ by more
        x.open(), y.open()
        bound = width * (1 / math.sqrt(x.passed) + 1 / math.sqrt(y.passed))
        if abs(x.ended / x.passed - y.ended / y.passed) > bound:
            return False
        for s in x.count.keys() | y.count.keys():
            if abs(x.count.get(s, 0) / x.passed - y.count.get(s, 0) / y.passed) > bound:
                return False
        stack += [(x.to[s], y.to[s]) for s in x.to.keys() & y.to.keys()]
    return True


def fold(a: State, b: State) -> None:
    """Add the tree of ``b`` to what starts at ``a``."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        x.passed += y.passed
        x.ended += y.ended
        if x.rest is not None and y.rest is not None:
            few, many = sorted((x.rest, y.rest), key=len)
            many += few
            x.rest = many
            continue
        x.open(), y.open()
        for s, n in y.count.items():
            x.count[s] = x.count.get(s, 0) + n
            if s in x.to:
                stack.append((x.to[s], y.to[s]))
            else:
                x.to[s] = y.to[s]


def infer(values: list[str], alpha: float = 0.01) -> Automaton | None:
    """The automaton of single values; no values give none."""
    return infer_counted(Counter(map(word_of, values)), alpha)


def infer_counted(words: Mapping[str, int], alpha: float = 0.01) -> Automaton | None:
    """Merge each state next to the settled ones into a compatible settled state, or settle it. No words give none.

    ``words`` are those of ``word_of`` with the numbers of values they stand
    for. The state most values pass goes first; among equal ones the one that
    follows the state settled first, then the smaller symbol.
    """
    if not words:
        return None
    root = State([(word, 0, n) for word, n in words.items()]).open()
    root.number, settled = 0, [root]
    while True:
        fringe = [(-b.passed, r.number, s) for r in settled for s, b in r.to.items() if b.number is None]
        if not fringe:
            break
        _, i, s = min(fringe)
        b = settled[i].to[s]
        for a in settled:
            if compatible(a, b, alpha):
                settled[i].to[s] = a
                fold(a, b)
                break
        else:
            b.open().number = len(settled)
            settled.append(b)
    steps, ends, floors = [], [], []
    for x in settled:
        total = x.passed + 1
        steps.append({symbols(s)[0]: (x.to[s].number, math.log(n / total)) for s, n in x.count.items()})
        ends.append(math.log((x.ended + 0.05) / total))
        floors.append(math.log(0.05 / total))
    return Automaton(steps, ends, floors, max(1, min(map(len, words))))

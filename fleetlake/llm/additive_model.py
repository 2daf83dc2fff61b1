"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted feature by feature in cycles with a small step, add up
to one lookup table per feature; then the pairs of features that explain most
of what is left get a two-dimensional table each, in the same way. A score is
the logistic of the intercept and one table value per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import NAMES, counts
from .frames import held_out, raw, release, small_batches

#: Rows the model is fitted on: those with the smallest hash of the identifier.
MAX_FIT_ROWS = 20_000
FEATURES = [
    "log_words", "word_length", "symbols", "equal_lines", "repeated_windows", "capitals", "letters", "marks", "digits",
    "neighbours", "distinct", "bars", "longest_word", "points", "line_words",
]


def features(text: bytes | None) -> list[float]:
    c = dict(zip(NAMES, counts(text)))
    words, chars, lines = max(c["n_words"], 1), max(c["word_chars"], 1), max(c["n_lines"], 1)
    return [
        float(np.log1p(c["n_words"])), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_upper"] / max(c["n_letters"], 1), c["n_letters"] / chars, c["n_marks"] / words,
        c["n_digits"] / chars, c["n_adjacent"] / words, c["n_distinct"] / words, c["n_bars"] / words,
        float(np.log1p(c["longest_word"])), c["n_points"] / words, float(np.log1p(c["n_words"] / lines)),
    ]


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.intercept)
        for b, t in zip(at, self.tables):
            total += t[b]
        for (i, j), t in self.pairs.items():
            total += t[at[i], at[j]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _gain(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Best cut of a histogram of gradients and curvatures: its gain and the first bin on the right."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gains = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
    if not len(gains) or gains.max() <= 0:
        return 0.0, 0
    k = int(gains.argmax())
    return float(gains[k] - g.sum() ** 2 / (h.sum() + 1)), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, least: float = 1.0) -> np.ndarray:
    """A tree over one binned feature: the step of each bin."""
    parts, step = [(0, len(g))], np.zeros(len(g))
    while len(parts) < leaves:
        found = [(*_gain(g[a:b], h[a:b], least), a, b) for a, b in parts]
        gain, k, a, b = max(found)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> tuple[float, np.ndarray]:
    """A tree that cuts one feature of a pair, then the other within each half."""
    best, step = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        _, k = _gain(gg.sum(axis=1), hh.sum(axis=1), least)
        for k in {k, len(gg) // 2} - {0}:
            out, gain = np.zeros_like(gg), 0.0
            for rows in (slice(0, k), slice(k, None)):
                a, b = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                out[rows] = _tree(a, b, 2, least)
                gain += float((out[rows][0] * a).sum())
            if gain > best:
                best, step = gain, out.T if turned else out
    return best, step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, pairs: int = 8, rate: float = 0.15) -> AdditiveModel:
    """Fit on rows ``x`` and labels ``y`` of 0 and 1; with no rows, or one class only, the score is the smoothed prior."""
    model = AdditiveModel()
    p = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(p / (1 - p)))
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    if len(np.unique(y)) < 2:
        return model
    at, total = model.bins(x), np.full(len(y), model.intercept)

    def slopes():
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j, b in enumerate(at):
            g, h = slopes()
            step = rate * _tree(np.bincount(b, g, sizes[j]), np.bincount(b, h, sizes[j]))
            model.tables[j] += step
            total += step[b]

    def cells(i, j):
        return at[i] * sizes[j] + at[j]

    def histogram(i, j, g, h):
        shape, n = (sizes[i], sizes[j]), sizes[i] * sizes[j]
        return np.bincount(cells(i, j), g, n).reshape(shape), np.bincount(cells(i, j), h, n).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_pair_tree(*histogram(*p, g, h))[0])
    model.pairs = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in ranked[:pairs]}
    for _ in range(rounds // 5):
        for (i, j), grid in model.pairs.items():
            _, step = _pair_tree(*histogram(i, j, *slopes()))
            grid += rate * step
            total += rate * step[at[i], at[j]]
    return model


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([features(t) for t in raw(texts)], pa.list_(pa.float64()))
    release()


def quality_score(model: AdditiveModel, text: Column) -> Column:
    """The score of a text column as a column; a null text is scored like an empty one."""
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t) for t in raw(texts)], float).reshape(-1, len(FEATURES))
            yield pa.array(model.score(x), pa.float64())
        release()

    return score(text)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          folds: int = 3, max_rows: int = MAX_FIT_ROWS) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold.

    Labels other than 0 and 1 and null identifiers are ignored; several labels
    of one document count as their majority, a draw as 1. Only the features of
    the sample reach the driver.
    """
    marked = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, folds))
        .groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    # The limit bounds the broadcast: max_rows pairs of numbers.
    rows = (
        small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")
        .select("id", "y", text_features("text").alias("x")).orderBy(F.xxhash64("id"), "id", "x").limit(max_rows).collect())
    x = np.array([r.x for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in rows], float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` per row; empty and null texts are scored, an empty table gives no rows."""
    model = learn(docs, labels, id_col, text_col, label_col, folds)
    scored = docs.select(F.col(id_col).alias("id"), quality_score(model, F.col(text_col)).alias("score"))
    return scored.select(
        F.col("id").alias(id_col), held_out("id", folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

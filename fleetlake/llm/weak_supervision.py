"""Quality rules as weak supervision.

Each rule votes bad (-1), good (1) or abstains (0). The votes are counted per
pattern over all documents, expectation-maximisation estimates the prior and
each rule's vote rates in either class from the counts, and a document is kept
by its posterior probability instead of having to pass every rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import NAMES, counts
from .frames import cut_lineage, raw, small_batches


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: Pseudo-documents per rule: votes (bad, good) on good documents, on bad ones. A rule seldom accuses a good document.
#: They decide tables of fewer than some hundred documents, and say nothing next to large ones.
PSEUDO = np.array([[[0.1, 99.9]], [[1.0, 1.0]]])


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on and good up to ``good`` of a value; in between it abstains."""

    name: str
    value: Column
    good: float
    bad: float

    def vote(self) -> Column:
        up = self.bad > self.good
        v = self.value
        return F.when(v >= self.bad if up else v <= self.bad, -1).when(v <= self.good if up else v >= self.good, 1).otherwise(0)


def rules() -> list[Rule]:
    """One rule per kind of fault: rules that see the same fault would count it several times."""
    return [
        Rule("long_words", _share("word_chars", "n_words"), 9, 14),
        Rule("short_words", _share("word_chars", "n_words"), 3.5, 2),
        Rule("marks", (F.col("n_symbols") + F.col("n_marks")) / F.greatest(F.col("n_words"), F.lit(1)), 0.05, 0.2),
        Rule("equal_lines", _share("n_dup_lines", "n_lines"), 0.3, 0.7),
        Rule("repeated_neighbours", _share("n_adjacent", "n_words"), 0.05, 0.2),
        Rule("capitals", _share("n_upper", "n_letters"), 0.15, 0.5),
        Rule("no_letters", _share("n_letters", "word_chars"), 0.8, 0.5),
    ]


@dataclass(frozen=True)
class VoteModel:
    """Prior of good and, per rule, the log ratio good : bad of either vote (-1, 1); an abstention says nothing."""

    prior: float
    weights: list[dict[int, float]]
    accuracy: list[float]

    def posterior(self, votes: list[Column]) -> Column:
        total = F.lit(_logit(self.prior))
        for vote, w in zip(votes, self.weights):
            total = total + F.when(vote == -1, w[-1]).when(vote == 1, w[1]).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit_votes(patterns: np.ndarray, weight: np.ndarray, balance: float | None = None, rounds: int = 200) -> VoteModel:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and their numbers of documents.

    It starts from "good unless a rule says bad". A vote rate is taken over the
    documents on which the rule votes, with the pseudo-documents of PSEUDO, so
    unseen votes keep a finite weight; no documents give an even prior and no
    weights. ``balance`` fixes the share of good documents; without it the
    share is estimated too, which needs several rules that see the same fault.
    """
    m = patterns.shape[1]
    if not weight.sum():
        return VoteModel(0.5, [{-1: 0.0, 1: 0.0}] * m, [0.5] * m)
    onehot = np.stack([patterns == v for v in (-1, 1)], axis=2).astype(float)
    good = np.where((patterns == -1).any(axis=1), 0.02, 0.98)
    for _ in range(rounds):
        share = np.stack([good, 1 - good]) * weight
        prior = balance or float((share[0].sum() + 1) / (share.sum() + 2))
        votes = np.einsum("cp,pmv->cmv", share, onehot) + PSEUDO
        rates = votes / votes.sum(axis=2, keepdims=True)
        ratio = np.log(rates[0]) - np.log(rates[1])
        logit = _logit(prior) + np.einsum("pmv,mv->p", onehot, ratio)
        before, good = good, 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
        if np.abs(good - before).max() < 1e-9:
            break
    right = votes[0, :, 1] + votes[1, :, 0]
    return VoteModel(prior, [dict(zip((-1, 1), map(float, w))) for w in ratio], list(map(float, right / votes.sum(axis=(0, 2)))))


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in NAMES]))
def text_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = [counts(t) for t in raw(texts)]
        columns = zip(*rows) if rows else [[] for _ in NAMES]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: its counts, base verdict, votes, posterior quality and whether it is kept.

    The counts are written once; the patterns of all documents the base rules
    let pass give the model (at most 3 to the number of rules rows reach the
    driver). What the base rules reject, mostly short texts, would make a class
    of its own and hide the faults the other rules see. A null or empty
    text has no words and fails the base rules; repeated rows and null
    identifiers stay as they are, an empty table gives no rows.
    """
    all_rules = rules()
    found = cut_lineage(small_batches(docs).select(F.col(id_col).alias("id"), text_counts(F.col(text_col)).alias("c")).select("id", "c.*"))
    votes = found.select("id", *NAMES, *[r.vote().cast("int").alias(f"vote_{r.name}") for r in all_rules])
    names = [f"vote_{r.name}" for r in all_rules]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    patterns = votes.where(~failed).groupBy(*names).count().collect()
    seen, weight = np.array([[r[n] for n in names] for r in patterns], int).reshape(-1, len(names)), np.array([r["count"] for r in patterns], float)
    # Few faults are seen by two rules, so the share of good documents is the share no rule accuses.
    clean = weight[~(seen == -1).any(axis=1)].sum()
    model = fit_votes(seen, weight, (clean + 1) / (weight.sum() + 2))
    scored = votes.withColumn("quality", model.posterior([F.col(n) for n in names])).withColumn("base_failed", failed)
    return scored.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality", *names)

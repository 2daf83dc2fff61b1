import math
from collections import Counter

import numpy as np
from odd import with_odd

from fleetlake.llm import weak_supervision as W

SF = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    words = [w for w in text.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.translate({c: 32 for c in range(9, 14)}).strip(" "):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = [any(grams.get(tuple(words[j:j + 3]), 0) > 1 for j in range(max(0, i - 2), i + 1) if j + 3 <= len(words)) for i in range(len(words))]
    n, rep = len(words), sum(hit)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, rep, n < 50 or 100 * rep > 50 * n


def test_counts_and_verdicts(spark):
    docs = with_odd(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    want = Counter((r.doc_id, *plain(r.text)) for r in docs.collect())
    rows = W.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(bool(q) == k for q, k in judged) / len(judged) > 0.95
    assert W.judge(docs.limit(0)).count() == 0


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    good, right = rng.random(40_000) < 0.8, np.array([0.95, 0.9, 0.85, 0.8])
    votes = np.where(rng.random((40_000, 4)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = W.fit_votes(patterns, n.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(np.array(model.accuracy) - right).max() < 0.03
    assert W.fit_votes(np.empty((0, 4), int), np.empty(0)).prior == 0.5


def plain_em(votes, balance, rounds):
    """Expectation-maximisation, one document and one rule at a time."""
    m = len(votes[0])
    good = [0.02 if -1 in v else 0.98 for v in votes]
    for _ in range(rounds):
        rates = []
        for side in (0, 1):
            rates.append([])
            for r in range(m):
                n = {x: float(np.broadcast_to(W.PSEUDO, (2, m, 2))[side][r][k]) for k, x in enumerate((-1, 1))}
                for v, p in zip(votes, good):
                    if v[r]:
                        n[v[r]] += p if side == 0 else 1 - p
                rates[side].append({x: c / sum(n.values()) for x, c in n.items()})
        good = []
        for v in votes:
            logit = math.log(balance / (1 - balance))
            for r, x in enumerate(v):
                if x:
                    logit += math.log(rates[0][r][x]) - math.log(rates[1][r][x])
            good.append(1 / (1 + math.exp(-logit)))
    return good


def test_posteriors_equal_a_plain_expectation_maximisation(spark):
    docs = with_odd(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    rows = W.judge(docs).collect()
    names = [c for c in rows[0].asDict() if c.startswith("vote_")]
    passed = [r for r in rows if not r.base_failed]
    votes = [tuple(r[n] for n in names) for r in passed]
    balance = (sum(-1 not in v for v in votes) + 1) / (len(votes) + 2)
    want = plain_em(votes, balance, 200)
    assert max(abs(r.quality - p) for r, p in zip(passed, want)) < 1e-6
    assert all(r.kept == (p >= 0.5) for r, p in zip(passed, want))

import math

import numpy as np
import pytest
from odd import with_odd
from pyspark.sql import functions as F

from fleetlake.llm import additive_model as A

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = with_odd(spark, spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/labels.parquet")
    rows = A.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert A.classify(docs.limit(0), labels).count() == 0


def test_no_labels_give_the_prior(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(5), spark.read.parquet(f"{SF}/labels.parquet")
    assert {r.score for r in A.classify(docs, labels.limit(0)).collect()} == {0.5}
    one = labels.withColumn("quality", F.lit(1))
    assert {r.predicted for r in A.classify(docs, one).collect()} == {1}


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(A.held_out("doc_id", 3), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in A.classify(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in A.classify(docs, turned).collect()}


def test_pairs_are_learnt():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = A.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


def plain_score(model, row):
    """Tables looked up one by one: a value's bin is the number of edges not greater than it."""
    at = [sum(e <= v for e in edges) for edges, v in zip(model.edges, row)]
    total = model.intercept
    for j, b in enumerate(at):
        total += model.tables[j][b]
    for (i, j), grid in model.pairs.items():
        total += grid[at[i]][at[j]]
    return 1 / (1 + math.exp(-max(-35, min(35, total))))


def test_scores_equal_tables_looked_up_one_by_one(spark):
    docs, labels = with_odd(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = A.learn(docs, labels)
    assert model.pairs and len(model.tables) == len(A.FEATURES)
    rows = docs.select("doc_id", "text", A.quality_score(model, F.col("text")).alias("score")).collect()
    for r in rows:
        assert r.score == pytest.approx(plain_score(model, A.features((r.text or "").encode())), abs=1e-12)


def plain_tree(g, h, leaves, least):
    """Split whichever part gains most at its best cut, trying every cut."""
    def best(a, b):
        found = (0.0, 0)
        whole = sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
        top = None
        for k in range(a + 1, b):
            hl, hr = sum(h[a:k]), sum(h[k:b])
            if hl >= least and hr >= least:
                parts = sum(g[a:k]) ** 2 / (hl + 1) + sum(g[k:b]) ** 2 / (hr + 1)
                if parts > 0 and (top is None or parts > top + 1e-12):
                    top, found = parts, (parts - whole, k)
        return found

    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, k, a, b = max((*best(a, b), a, b) for a, b in parts)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    step = [0.0] * len(g)
    for a, b in parts:
        for i in range(a, b):
            step[i] = sum(g[a:b]) / (sum(h[a:b]) + 1)
    return step


@pytest.mark.parametrize("seed", range(40))
def test_a_boosting_step_equals_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 14))
    g, h = rng.normal(size=n) * 5, rng.random(n) * 3
    assert A._tree(g, h).tolist() == pytest.approx(plain_tree(g.tolist(), h.tolist(), 3, 1.0), abs=1e-9)


def test_a_round_lowers_the_loss():
    rng = np.random.default_rng(4)
    x = rng.random((500, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.normal(size=500) > 0.6).astype(float)
    loss = []
    for rounds in (0, 1, 5, 25):
        p = np.clip(A.fit(x, y, rounds=rounds, pairs=1).score(x), 1e-9, 1 - 1e-9)
        loss.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    assert loss == sorted(loss, reverse=True) and loss[-1] < 0.5 * loss[0]

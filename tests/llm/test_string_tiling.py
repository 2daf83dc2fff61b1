import random
import re
import time
from collections import Counter

import numpy as np
from odd import with_odd
from pyspark.sql import functions as F

from fleetlake.llm import string_tiling as S


def plain_tiles(text, item, least):
    """Greedy string tiling by comparing everything."""
    a, b, tiles = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while i + k < len(text) and j + k < len(item) and a[i + k] and b[j + k] and text[i + k] == item[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return tiles
        tiles.append((i, j, k))
        for x in range(k):
            a[i + x] = b[j + x] = False


def test_tiles_equal_plain_tiling():
    rng = random.Random(3)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randrange(3, 30))]
        text = [rng.randrange(6) for _ in range(20)] + item[len(item) // 2:] + [rng.randrange(6)] + item[:len(item) // 2] + [rng.randrange(6) for _ in range(15)]
        want = plain_tiles(text, item, 4)
        assert S.tile(np.array(text), np.array(item), 4) == want


def test_query_and_filter(spark):
    docs = with_odd(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").union(
        spark.createDataFrame([(9001, None), (9002, ""), (9003, "too short"), (9005, "Zeta eta"), (9006, "Number here at all"), (9004, "Alpha beta, gamma delta epsilon. Zeta eta theta iota kappa")], "item_id long, text string"))
    turned = docs.limit(1).withColumn("doc_id", F.lit(500_000).cast("long")).withColumn(
        "text", F.lit("x zeta eta theta iota kappa y ALPHA beta gamma -- delta epsilon z"))
    docs = docs.union(turned)
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    bench, want = [(r.item_id, words(r.text)) for r in items.collect()], Counter()
    for r in docs.collect():
        w = words(r.text)
        # An item of few words must be there whole.
        want.update((r.doc_id, k, len(item)) for k, item in bench if 0 < len(item) < 5 and item in (w[i:i + len(item)] for i in range(len(w))))
        grams = set(zip(*[w[i:] for i in range(5)]))
        for k, item in bench:
            if any(g in grams for g in zip(*[item[i:] for i in range(5)])):
                near = [x if any(tuple(w[j:j + 5]) in set(zip(*[item[i:] for i in range(5)])) for j in range(max(0, p - 4), p + 1)) else None for p, x in enumerate(w)]
                covered = sum(t[2] for t in plain_tiles([x for x in near], [y for y in item], 5))
                if 2 * covered >= len(item):
                    want[(r.doc_id, k, covered)] += 1
    got = S.overlaps(docs, items)
    assert Counter((r.doc_id, r.item_id, r.covered) for r in got.collect()) == want
    assert {(500_000, 9004, 10), (500_000, 9005, 2), (None, 9006, 4)} <= set(want) and len(want) > 5
    clean = S.decontaminate(docs, items)
    bad = {d for d, _, _ in want}
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in bad)
    assert S.overlaps(docs.limit(0), items).count() == 0 and S.overlaps(docs, items.limit(0)).count() == 0


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted((r.doc_id, r.item_id, r.covered) for r in S.overlaps(docs, items).collect())
    monkeypatch.setattr(S, "BLOCK_CHARS", 2000)
    assert sorted((r.doc_id, r.item_id, r.covered) for r in S.overlaps(docs, items).collect()) == want


def test_many_items_with_one_opening():
    """Thousands of items that begin alike, and a text that repeats the opening a thousand times."""
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(10**6))
    opening = " ".join(word() for _ in range(7))
    tails = [" ".join(word() for _ in range(12)) for _ in range(5000)]
    items = S.Items([f"{opening} {t}" for t in tails], 5)
    text = " x ".join([opening] * 1000) + f" {tails[77]} y {tails[4000]}"
    start = time.perf_counter()
    found = items.matches(text, 0.5)
    assert time.perf_counter() - start < 20
    w = text.split()
    want = []
    for k in (77, 4000):
        item = f"{opening} {tails[k]}".split()
        grams = set(zip(*[item[i:] for i in range(5)]))
        at = {j + i for j in range(len(w) - 4) if tuple(w[j:j + 5]) in grams for i in range(5)}
        # The passages that may match: the last openings and the tails.
        cut = len(w) - 60
        near = [x if i in at else None for i, x in enumerate(w)][cut:]
        want.append((k, sum(t[2] for t in plain_tiles(near, item, 5))))
    assert [(k, covered) for k, covered, _ in found] == want

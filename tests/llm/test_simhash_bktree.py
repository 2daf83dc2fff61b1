import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlake.llm import simhash_bktree as S
from fleetlake.llm.components import components


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    return [min((ids[j] for j in range(len(ids)) if find(j) == find(i)), default=None) for i in range(len(ids))]


def test_same_as_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(900001, None), (900002, ""), (900003, "Only two"), (900004, "only TWO"), (900005, "a b c\x0bd e\x1cf")], docs.schema)
    docs = docs.union(odd).union(docs.limit(3)).withColumn("fp", F.lit("clash"))
    rows = docs.collect()
    prints = [plain_print(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], (f"{p:016x}" for p in prints), classes([r.doc_id for r in rows], prints)))
    assert sorted(map(tuple, S.near_duplicates(docs).collect())) == want
    assert S.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tree_rows, levels", [(20_000, 3), (7, 3), (7, 0), (12, 1)])
def test_links_give_the_classes_of_all_pairs(spark, monkeypatch, tree_rows, levels):
    rng = random.Random(5)
    # Many share all but their last bits.
    prints = {0xABCD_0123_4567_0000 | rng.getrandbits(12) for _ in range(60)}
    monkeypatch.setattr(S, "LEVELS", levels)
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 8, 30])):
            x = base
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    monkeypatch.setattr(S, "TREE_ROWS", tree_rows)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    roots = {r.node: r.root for r in components(S.link_fingerprints(df)).collect()}
    want = classes(prints, prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got, back = [roots.get(p, p) for p in signed], {}
    for c, w in zip(got, want):
        assert back.setdefault(c, w) == w
    assert len(set(got)) == len(set(want))


def test_one_full_block_value_makes_even_groups(spark, monkeypatch):
    """Most fingerprints agree on three blocks; no group of trees and searches holds many of them."""
    monkeypatch.setattr(S, "TREE_ROWS", 300)
    monkeypatch.setattr(S, "LEVELS", 0)
    rng = random.Random(6)
    prints = sorted({0x1111_2222_3333_0000 | rng.getrandbits(16) for _ in range(3000)})
    rows = spark.createDataFrame([(p,) for p in prints], "fp long").select("fp", F.col("fp").alias("rest"), F.lit(7).cast("bigint").alias("key"))
    groups = S._sliced(rows.withColumn("count", F.lit(len(prints)).cast("bigint"))).groupBy("salt").count().collect()
    n = -(-len(prints) // 300)
    assert len(groups) == n * n and max(r["count"] for r in groups) < 2.5 * 300


def test_keep_one_with_repeated_identifiers(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "quite another text here"), (None, "a b c d"), (None, "only without number"), (None, "only without number"), (5, "a b c d"),
            (6, "six words stand alone in here"), (0, "quite another text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in S.keep_one(docs).collect()), key=str)
    assert got == sorted([(0, "quite another text here"), (1, "a b c d"), (6, "six words stand alone in here"), (None, "only without number")], key=str)
    assert S.keep_one(docs).columns == docs.columns


def test_components_of_paths_and_cycles(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}

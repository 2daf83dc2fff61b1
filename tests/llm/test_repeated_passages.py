import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from odd import with_odd

from fleetlake.llm import fm_index, queries
from fleetlake.llm import repeated_passages as R

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(rows, length=50):
    """Rows (id, text): every window against the smallest identifier that holds it."""
    split = [(R.NO_ID if i is None else i, i, WORD.findall((t or "").encode())) for i, t in rows]
    first = {}
    for key, _, w in split:
        for a in range(len(w) - length + 1):
            t = tuple(w[a:a + length])
            first[t] = min(first.get(t, key), key)
    out = Counter()
    for key, i, w in split:
        gone = bytearray(len(w))
        for a in range(len(w) - length + 1):
            if first[tuple(w[a:a + length])] < key:
                gone[a:a + length] = b"\x01" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        kept = b" ".join([x for x, g in zip(w, gone) if not g])
        out[(i, len(w), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)] += 1
    return out


def check(docs, length=50):
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], length)
    assert Counter((*r[:5], bytes(r[5])) for r in R.remove_passages(docs, length=length).collect()) == want
    return want


def made_up(seed, n=120, words=("a", "b", "cé", "d")):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passages = [text(60), text(50), text(49), text(130), " ".join(["x"] * 200)]
    rows = []
    for i in range(n):
        parts = [text(rng.randrange(80)), rng.choice(passages), text(rng.randrange(40)), rng.choice(passages), text(rng.randrange(3))]
        rows.append((i // 2 if i < 20 else i, rng.choice([" ", "\n", "\x0b \t"]).join(parts)))
    rows += [(500 + i, rows[30][1]) for i in range(60)] + [(7, rows[40][1]), (7, rows[40][1]), (None, rows[50][1]), (None, rows[51][1]), (None, None), (8, "")]
    return rows


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(150):
        k, most = rng.randrange(1, 6), rng.choice([1, 2, 3, 5, 8, 50])
        held = [[rng.randrange(1, k + 1) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 8))]
        streamed = [[rng.randrange(1, k + 3) for _ in range(rng.randrange(30))] for _ in range(5)] + held
        row = lambda x: np.array([v for s in x for v in s], np.int64)
        index = fm_index.FmIndex(row(held), np.array([len(s) for s in held]), most)
        length, low, high = index.matching_statistics(row(streamed), np.array([len(s) for s in streamed]))
        owner = np.arange(len(held))[::-1].copy()
        least, at = index.least_of_classes(owner), 0
        for q in streamed:
            for i in range(len(q)):
                best, found = 0, None
                for m in range(1, min(most, len(q) - i) + 1):
                    hits = sorted(s for s, x in enumerate(held) for j in range(len(x) - m + 1) if x[j:j + m] == q[i:i + m])
                    if not hits:
                        break
                    best, found = m, hits
                assert length[at] == best
                if best:
                    assert sorted(index.sequence[index.suffix[low[at]:high[at]]].tolist()) == found
                if best == most:
                    assert least[index.class_of[low[at]]] == min(owner[s] for s in found)
                at += 1


def test_documents(spark):
    docs = with_odd(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).repartition(6)
    want = check(docs)
    assert sum(x[2] for x in want) > 500
    assert R.remove_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [R.BLOCK_BYTES, 1500])
def test_passages_overlaps_and_ties(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_BYTES", block)
    want = check(spark.createDataFrame(made_up(1), "doc_id long, text string").repartition(4))
    assert sum(x[3] for x in want) > 100


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT_CONTEXTS", 3)
    check(spark.createDataFrame(made_up(2), "doc_id long, text string").repartition(4))


def test_long_texts_in_parts(monkeypatch):
    """Every window has the same anchor whether its text is taken whole or in parts."""
    rows = made_up(4)
    batch = pa.RecordBatch.from_arrays([pa.array([(t or "").encode() for _, t in rows])], names=["text"])

    def windows():
        return {(k, a + j): x for _, *found in R._texts(batch, 50) for x, k, a, m in zip(*[c.tolist() for c in found]) for j in range(m)}

    whole = windows()
    monkeypatch.setattr(R, "PART_WORDS", 70)
    assert windows() == whole and len(whole) > 5000


def test_other_lengths(spark):
    check(spark.createDataFrame(made_up(5), "doc_id long, text string").repartition(3), 7)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from '{folder}/documents.parquet'")
    got = queries.op11_fm_index(spark, folder)
    want = Counter(duckdb.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE['op11_fm_index']})").fetchall())
    assert Counter(map(tuple, got.collect())) == want

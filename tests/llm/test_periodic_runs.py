import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import with_odd

from fleetlake.llm import periodic_runs as P
from fleetlake.llm import queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_runs(w, least=12):
    """Every period in turn: stretches of words that agree with the word a period on."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, 2 * q) and not any(w[i:i + n - d] == w[i + d:i + n] for d in range(1, q)):
                found.append((i, n, q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, edit):
    w = WORD.findall((text or "").encode())
    n = len(w)
    if edit and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    text = b" ".join([x for i, x in enumerate(w) if i not in dropped])
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
    return doc_id, len(runs), *best, best[1] and best[1] * 1000 // best[2], digest, hashlib.sha256(text).hexdigest()


def plain_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def test_group_lengths_are_the_lyndon_array():
    rng = random.Random(2)
    for _ in range(1500):
        s = [rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(40))]
        assert P.lyndon_lengths(s) == plain_lyndon(s)
        assert P.lyndon_lengths(s, reverse=True) == plain_lyndon([-x for x in s])


def test_runs_of_made_up_words():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            k, n = rng.randrange(1, 6), rng.randrange(60)
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6:
                w = ([rng.randrange(k) for _ in range(rng.randrange(1, 20))] * 60)[:n]
                for _ in range(rng.randrange(3) if n else 0):
                    w[rng.randrange(n)] = rng.randrange(k)
            texts.append(w)
        least = rng.choice([2, 5, 12])
        want, at = [], 0
        for w in texts:
            want += [(s + at, n, q) for s, n, q in plain_runs(w, least)]
            at += len(w)
        words = np.array([x for w in texts for x in w], np.int64)
        found = P.runs_of(words, np.repeat(np.arange(len(texts)), [len(w) for w in texts]), least)
        assert list(zip(*[x.tolist() for x in found])) == want


def test_hashes_that_collide_do_not_make_runs():
    """Words of the Thue-Morse sequence have equal hashes modulo 2 to the 64, and no run of twelve words but squares."""
    w = [bin(i).count("1") & 1 for i in range(6000)]
    found = P.runs_of(np.array(w), np.zeros(len(w), np.int64))
    for s, n, q in zip(*[x.tolist() for x in found]):
        assert w[s:s + n - q] == w[s + q:s + n] and n >= max(12, 2 * q)
        assert s == 0 or w[s - 1] != w[s - 1 + q]
        assert s + n == len(w) or w[s + n] != w[s + n - q]
    short = w[:700]
    assert list(zip(*[x.tolist() for x in P.runs_of(np.array(short), np.zeros(700, np.int64))])) == plain_runs(short)


@pytest.mark.parametrize("block", [P.BLOCK_BYTES, 3000])
def test_query_on_documents(spark, monkeypatch, tmp_path, block):
    docs = with_odd(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    # The brute force is cubic; the very long odd text has its own test below.
    docs = docs.where("doc_id is null or (doc_id != 900006 and length(text) < 12000)")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(P, "BLOCK_BYTES", block)
    got = queries.op13_periodic_runs(spark, str(tmp_path)).drop("n_words")
    want = Counter(plain_row(r.doc_id, r.text, True) for r in docs.collect())
    assert Counter(map(tuple, got.collect())) == want
    assert sum(n > 0 for _, n, *_ in want) > 20


def test_odd_rows(spark):
    docs = with_odd(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(3))
    rows = P.find_runs(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    long = by_id[900006]
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 30_000, 1, 30_000_000)
    assert long.collapsed == b"word" and [tuple(r) for r in long.runs] == [(0, 30_000, 1)]
    for odd in (900001, 900002, 900003):
        r = by_id[odd]
        assert (r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs) == (0, 0, None, None, None, None, [])
        assert r.runs_sha256 == r.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id[None].collapsed == b"no number here at all"
    assert P.find_runs(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "x y z " * 5 + "q")], "doc_id long, text string")
    assert [tuple(r) for r in P.find_runs(one).first().runs] == [(0, 15, 3)]
    assert P.find_runs(one).first().collapsed == b"x y z q"

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlake.llm import conversation_trie as C
from fleetlake.llm import parentheses, queries


def plain(rows, heads=True):
    """Nested dictionaries over rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        built[c] = own.get(c - c % 20, [])[:h] + x[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, x in sorted(built.items()):
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
        ends[tuple(x)].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        cost = (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += kids[p] == 0
    return Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def trie(convs, heads=True, shards=5):
    turns = C.turns_of(convs)
    return C.prefix_trie(C.with_shared_heads(turns) if heads else turns, shards)


def found(df):
    return Counter(map(tuple, df.select(C.RESULT).collect()))


def random_tree(rng, n):
    bits, open_ = [1], 1
    while n:
        if open_ > 1 and rng.random() < 0.45:
            bits.append(0)
            open_ -= 1
        else:
            bits.append(1)
            open_ += 1
            n -= 1
    return np.array(bits + [0] * open_, bool)


@pytest.mark.parametrize("n", [0, 1, 5, 31, 32, 200, 5000])
def test_parentheses(n):
    rng = random.Random(n)
    shapes = [random_tree(rng, n), np.array([1] * (n + 1) + [0] * (n + 1), bool), np.array([1] + [1, 0] * n + [0], bool)]
    for bits in shapes:
        p = parentheses.Parentheses(bits)
        stack, close = [], {}
        for i, b in enumerate(bits.tolist()):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert p.opens().tolist() == opens.tolist()
        assert p.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
        at = np.arange(len(bits) + 1)
        assert p.excess(at).tolist() == np.concatenate(([0], np.cumsum(np.where(bits, 1, -1)))).tolist()
        pairs = bits & ~np.append(bits[1:], True)
        assert p.leaf_pairs(at).tolist() == np.concatenate(([0], np.cumsum(pairs))).tolist()


def test_range_least():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 100, 77)
    least = parentheses.RangeLeast(values)
    first = rng.integers(0, 77, 500)
    end = first + 1 + rng.integers(0, 77 - first)
    assert least(first, end).tolist() == [min(values[a:b]) for a, b in zip(first.tolist(), end.tolist())]


@pytest.mark.parametrize("shards", [1, 7])
def test_given_conversations(spark, shards):
    convs = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain(convs.select("conv_id", "turn", "role", "text").collect())
    assert found(trie(convs, shards=shards)) == want
    assert max(n for _, d, _, n, *_ in want if d) > 2


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view conversations as select * from '{folder}/conversations.parquet'")
    want = Counter(duckdb.sql("select " + ", ".join(C.RESULT) + f" from ({queries.ORACLE['op12_prefix_trie']})").fetchall())
    assert found(queries.op12_prefix_trie(spark, folder)) == want


@pytest.mark.parametrize("heads", [True, False])
def test_made_up_conversations(spark, monkeypatch, heads):
    monkeypatch.setattr(C, "PIECE", 3)
    rng = random.Random(8)
    rows = []
    for c in [*range(150), 2000, 2001, 2019, 4007]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a b", "", None, "c\td", "é a"])))
    # A third of all rows is the same conversation, one is long, rows repeat, and some have no number.
    rows += [(c, t, "user", f"same {t}") for c in range(5000, 5200) for t in range(3)]
    rows += [(9000, t, "user", "x " * (t % 3)) for t in range(300)] + [(9001, t, "user", "x " * (t % 3)) for t in range(299)]
    rows += rows[:40] + [(None, 1, "user", "lost")]
    convs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("path", F.lit(1)).withColumn("hash", F.lit("x")).repartition(7)
    # Equal turn numbers with other texts go by hash; the plain version must see that order.
    hashed = [(c, None if t is None else t, r, x) for c, t, r, x in rows]
    got = found(trie(convs, heads, shards=9))
    order = lambda r, x: (r or "", hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest())
    numbered = defaultdict(list)
    for c, t, r, x in hashed:
        if c is not None:
            numbered[c].append(((t is not None, t or 0), order(r, x), r, x))
    plain_rows = [(c, i, r, x) for c, own in numbered.items() for i, (_, _, r, x) in enumerate(sorted(own, key=lambda y: y[:2]))]
    assert got == plain(plain_rows, heads)
    assert any(n >= 200 for _, _, _, n, *_ in got)


def test_turnless_and_empty(spark):
    kind = "conv_id long, turn int, role string, text string"
    assert trie(spark.createDataFrame([], kind)).count() == 0
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = [(short, 0, "user", "only one")]
    got = found(trie(spark.createDataFrame(rows, kind)))
    assert got == plain(rows) == {(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest()): 1}

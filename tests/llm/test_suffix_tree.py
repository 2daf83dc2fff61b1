import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import with_odd

from fleetlake.llm import suffix_tree as S
from fleetlake.llm.hashing import Table

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate({c: 32 for c in range(9, 14)}).split(" ") if w]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class PlainTree:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.next = defaultdict(Counter)
        for t in texts:
            data = b"\n" * 5 + t + b"\n"
            for i in range(5, len(data)):
                for d in range(6):
                    self.next[data[i - d:i]][data[i]] += 1
        total = {c: sum(x.values()) for c, x in self.next.items()}
        price = 0.25 * math.log(max(total.get(b"", 0), 2)) / 2
        self.kept = {b""}
        for c, x in self.next.items():
            if c and total[c] * math.log(256) > price:
                s = c[1:]
                gain = sum(n * math.log(n / total[c] / (self.next[s][b] / total[s])) for b, n in x.items())
                if gain > len(x) * price:
                    self.kept.add(c)
        self.total = total

    def p(self, context, byte):
        while context not in self.kept:
            context = context[1:]
        n = self.next[context][byte] if context in self.next else 0
        if not context:
            return (n + 0.5) / (self.total.get(b"", 0) + 128)
        return (n + 2 * self.p(context[1:], byte)) / (self.total[context] + 2)

    def score(self, t):
        data = b"\n" * 5 + t + b"\n"
        return sum(math.log10(self.p(data[i - 5:i], data[i])) for i in range(5, len(data)))


@pytest.mark.parametrize("frequent", [S.FREQUENT, 50])
def test_same_as_plain_model(spark, frequent):
    docs = with_odd(spark, spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(80)).repartition(3)
    rows = docs.collect()
    train = [words(r.text) for r in rows if not held(r.doc_id)]
    count = Counter(w for t in train for w in [*t, None])
    n, v = sum(count.values()), len(count)
    tree = PlainTree([" ".join(t).encode() for t in train])
    want = {}
    for r in rows:
        t = words(r.text)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t, None])
        want[(r.doc_id, len(t) + 1, sum(count[w] > 0 for w in [*t, None]))] = (held(r.doc_id), n, base, tree.score(" ".join(t).encode()))
    got = S.score_texts(docs, frequent=frequent).collect()
    assert len(got) == len(rows) and len(tree.kept) > 50
    for r in got:
        h, total, base, score = want[(r.doc_id, r.n_tokens, r.n_known)]
        assert (r.held_out, r.train_tokens) == (h, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-4)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert S.score_texts(docs.limit(0)).count() == 0
    only_held = docs.where(S.held_out("doc_id", 5))
    row = S.score_texts(only_held).orderBy("doc_id").first()
    assert row.train_tokens == 0 and row.n_known == 0
    assert row.base_score == pytest.approx(0.0)
    n = len(" ".join(words(only_held.orderBy("doc_id").first().text)).encode()) + 1
    assert row.score == pytest.approx(-n * math.log10(256), rel=1e-5)


def test_model_bound_and_gain_over_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0")
    got = S.score_texts(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    small = S.score_texts(docs, max_entries=500).where("held_out").selectExpr("sum(score)").first()
    assert got[0] > got[1] and got[0] > small[0]


def test_table():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 60, 5000).astype(np.uint64))
    table = Table(keys[:100], np.arange(100), -1)
    for i in range(100, len(keys), 700):
        table.add(keys[i:i + 700], np.arange(i, min(i + 700, len(keys))))
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert (table.get(keys + np.uint64(1 << 61)) == -1).all()


@pytest.mark.parametrize("sent", [0, 300, 3000])
def test_contexts_that_are_not_sent_are_used(spark, monkeypatch, sent):
    """The scores don't depend on how many contexts the tasks hold, nor on how full the filter is."""
    monkeypatch.setattr(S, "FILTER_BITS", 18)
    docs = with_odd(spark, spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(200)).repartition(3)
    column = lambda got: sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in got.collect())
    want, got = column(S.score_texts(docs)), column(S.score_texts(docs, sent=sent))
    assert len(want) == len(got) and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-4) for a, b in zip(want, got))


def test_the_price_does_not_depend_on_the_number_of_contexts(spark):
    grams = S.count_corpus(spark.read.parquet(f"{SF}/documents.parquet").limit(200)).where("gram is not null").select("gram", "n")
    kept = S.keep_contexts(grams).where("depth > 0").selectExpr("depth", "context")
    tree, others = S.learn_tree(grams, sent=500)
    sent = {int(k) for k in tree.table.keys if k != Table.EMPTY and int(k) >> 56 >= 128}
    states = {int(r.context) | r.depth + 128 << 56 for r in others.collect()}
    assert len(states) > 100 and not sent & states
    assert sent | states == {int(r.context) | r.depth + 128 << 56 for r in kept.collect()}

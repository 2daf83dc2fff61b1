import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from odd import with_odd
from tokenizers import Tokenizer

from fleetlake.llm import packing as P
from fleetlake.llm.encoding import Encoder

WORD = public_tokenizers.path("word_bpe_49k.json")


def whole(path):
    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_pieces_encode_like_whole_texts(spark):
    rng = random.Random(6)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    marks = ["a", "B", "é", "ß", "́", "1", "23", " ", "  ", "\n", "\t", "\r\n", " ", "\x1c", " ", "'s", "'", "!!", "|", "<|endoftext|>", "漢", "​", "Σ", "_"]
    texts += ["x<|endoftext|>y z", "<|ENDOFTEXT|>", "a <|startoftext|>", "<|endoftext|>" * 3, "word<|endoftext|> word <|endoftext |>", "\n<|endoftext|>\n\n a's"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(25))) for _ in range(4000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        encode, e = whole(path), Encoder(path)
        for _ in range(2):
            ids, sizes = e.encode([*texts, None], 0)
            at = 0
            for text, n in zip(texts, sizes.tolist()):
                assert ids[at:at + n].tolist() == [*encode(text), 0], (name, text)
                at += n


def test_words_of_equal_hash_are_told_apart():
    """Words of the Thue-Morse sequence have equal polynomial hashes modulo 2 to the 64, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    pairs = [("".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])) for n in (512, 1024, 2048, 4096)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encode, e = whole(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
        for texts in ([p[0] for p in pairs], [p[1] for p in pairs], [f"{x} {y} {x} end {y}" for x, y in pairs], [x + y for x, y in pairs]):
            ids, sizes = e.encode(texts)
            for text, part in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
                assert part.tolist() == encode(text)
        assert e.clashes


def test_pack(spark):
    docs = with_odd(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).repartition(7)
    encode, want = whole(WORD), defaultdict(int)
    for r in docs.collect():
        ids = np.array([*encode(r.text or ""), 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[(r.doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = P.pack(docs, WORD).collect()
    got, filled = defaultdict(int), defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        filled[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for spans in filled.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(k[3] * c for k, c in want.items())
    assert len(filled) <= 1.02 * (-(-total // 2048)) + 1
    assert P.pack(docs.limit(0), WORD).count() == 0


def test_plan_places_everything():
    rng = random.Random(2)
    for most in (5, 60, 700, 2048):
        histogram = {rng.randrange(1, most + 1): rng.randrange(1, 40) for _ in range(300)}
        configs = P.plan(dict(histogram))
        used = defaultdict(int)
        for config, copies in configs:
            assert sum(config) <= 2048 and copies > 0
            for n in config:
                used[n] += copies
        assert used == histogram
        counts = np.zeros(2049, int)
        counts[list(histogram)] = list(histogram.values())
        assert sum(c for _, c in configs) <= 1.01 * sum(c for _, c in P.best_fit(counts)) + 2
    assert P.plan({}) == [] and P.plan({2048: 3}) == [([2048], 3)]


def test_knapsack_is_best():
    rng = random.Random(8)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(3, 40), 5)))
        worth = np.array([rng.random() for _ in range(5)])
        best = [0.0] * 101
        for w in range(1, 101):
            best[w] = max([best[w - 1]] + [best[w - s] + v for s, v in zip(sizes, worth) if s <= w])
        use = P.knapsack(sizes, worth, 100)
        assert (use * sizes).sum() <= 100 and abs((use * worth).sum() - best[100]) < 1e-9

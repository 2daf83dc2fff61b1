import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
from odd import with_odd
from test_secret_grammar import plain as plain_secrets
from test_simhash_bktree import classes, plain_print
from test_string_tiling import plain_tiles
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402
from fleetlake.llm import additive_model as A  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages_against_plain_versions(spark, tmp_path):
    folder = str(tmp_path)
    with_odd(spark, spark.read.parquet(f"{SF}/documents.parquet")).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    good = P.quality_classifier(spark, docs, folder)
    model = A.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = lambda t: model.score(np.array([A.features((t or "").encode())]))[0]
    assert good.columns == docs.columns
    assert rows(good) == Counter(tuple(r) for r in docs.collect() if score(r.text) >= 0.5)

    # The next stages get rows of every kind, not only what the first one keeps.
    unique = P.simhash_near_dedup(spark, docs, folder)
    all_rows = docs.collect()
    prints = [plain_print(r.text) for r in all_rows]
    of = classes(list(range(len(all_rows))), prints)
    first = {}
    for c, r in zip(of, all_rows):
        order = (r.doc_id is None, r.doc_id or 0)
        first[c] = min(first.get(c, order), order)
    assert unique.columns == docs.columns
    assert Counter(r.doc_id for r in unique.collect()) == Counter(None if none else i for none, i in first.values())

    clean = P.benchmark_decontamination(spark, docs, folder)
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def leaks(text):
        w = words(text)
        grams = set(zip(*[w[i:] for i in range(5)]))
        for item in items:
            if sum(g in grams for g in zip(*[item[i:] for i in range(5)])) * 10 >= len(item):
                if 2 * sum(t[2] for t in plain_tiles(w[:3000], item, 5)) >= len(item):
                    return True
        return False

    assert rows(clean) == Counter(tuple(r) for r in all_rows if not leaks(r.text))

    masked = P.secret_scans(spark, docs, folder)
    assert masked.columns == docs.columns and masked.dtypes == docs.dtypes
    assert Counter(r.doc_id for r in masked.collect()) == Counter(r.doc_id for r in all_rows)
    for r in masked.collect():
        assert sum(plain_secrets(r.text)[:3]) == 0 and r.n_chars == (None if r.text is None else len(r.text))

    packed = P.best_fit_packing(spark, clean, folder)
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in clean.collect():
        ids = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[(r.doc_id, k // 2048, zlib.crc32(ids[k:k + 2048].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed.collect()) == want


def test_run_applies_every_stage(spark):
    out = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = docs
    for _, stage in P.STAGES:
        want = stage(spark, want, SF)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert rows(out.select(key)) == rows(want.select(key)) and out.count() > 100
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None

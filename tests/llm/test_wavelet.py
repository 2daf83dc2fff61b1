import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from odd import with_odd
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlake.llm import token_files as F7
from fleetlake.llm.wavelet import WaveletMatrix

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (511, 2), (512, 300), (513, 7), (5000, 50_000), (3000, 100_000)])
def test_matrix(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.random(n) ** 3 * top).astype(np.uint32)
    matrix = WaveletMatrix.of(ids)
    assert (matrix.decode() == ids).all()
    at = rng.integers(0, max(n, 1), 200) if n else np.empty(0, int)
    assert (matrix.access(at) == ids[at]).all()
    for token in [*ids[:30].tolist(), 0, top + 5, 1 << 20]:
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places)
        assert matrix.locate(token).tolist() == places.tolist()
        low, high = n // 3, n // 2
        assert matrix.count(token, low, high) == int((ids[low:high] == token).sum())


@pytest.mark.parametrize("shard_tokens", [F7.SHARD_TOKENS, 900])
def test_files(spark, tmp_path, shard_tokens):
    docs = with_odd(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).repartition(5)
    encoder = Tokenizer.from_file(BYTES)
    F7.write_tokens(docs, str(tmp_path / "t"), BYTES, shard_tokens=shard_tokens)
    rows = sorted(docs.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text is not None, r.text or ""))
    want, at, everything = Counter(), 0, []
    for r in rows:
        ids = [*encoder.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[(r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
        everything += ids
    got = F7.read_documents(spark, str(tmp_path / "t"))
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == want
    token = everything[10]
    assert sorted(r.place for r in F7.occurrences(spark, str(tmp_path / "t"), token).collect()) == [i for i, x in enumerate(everything) if x == token]
    assert {r.token: r.n for r in F7.token_counts(spark, str(tmp_path / "t"), [token, 50_255]).collect()} == {token: everything.count(token), 50_255: everything.count(50_255)}
    if shard_tokens == 900:
        assert len(list((tmp_path / "t").glob("*.parquet"))) > 20


def test_empty_table(spark, tmp_path):
    F7.write_tokens(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0), str(tmp_path / "t"), BYTES)
    assert F7.read_documents(spark, str(tmp_path / "t")).count() == 0

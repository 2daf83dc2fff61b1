"""Removal of passages that an earlier document holds, by FM-indexes over shards of the corpus.

Two equal windows of LENGTH words hold the same GRAM words of smallest hash at
the same place (their anchor). A shard gets the contexts, the windows in a row
around an anchor, of the anchors dealt to it, so a document is streamed only
through shards that may hold a match. Anchors of one document's number alone
go first, by hash. A context is indexed and streamed once however many
documents hold it. Backward search over the wavelet matrix of a shard gives the
matching statistics of every context; where a match reaches LENGTH words, the
smallest document number in its interval decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FmIndex
from .frames import pieces_of, release, shared_path, small_batches, values
from .hashing import mixed, run_hashes

LENGTH = 50
GRAM = 10
#: Bytes of text (packed text) worked on at a time, and words of a long text.
BLOCK_BYTES = 2_000_000
PACKED_BYTES = 700_000
PART_WORDS = 1 << 22
PLACE_BITS = 23
#: Bytes of distinct contexts a task holds before it sends them.
FLUSH_BYTES = 16_000_000
#: Bytes of distinct contexts in a shard on average at most; a shard is a task.
SHARD_BYTES = 6_000_000
#: An anchor in more distinct contexts than this is hot: its windows are dealt one by one.
HOT_CONTEXTS = 20_000
NO_ID = -(1 << 63)
_KEY = ["key", "text_hash"]
_CONTEXT_NAMES = [*_KEY, "anchor", "context", "start", "most", "words"]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (n[i] numbers) for all i in a row."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def anchors(words: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per anchor of texts in a row: hash, text, and first and last window start it serves (places in the row)."""
    gram = min(GRAM, length)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    grams, reach = mixed(run_hashes(words, gram)), length - gram + 1
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = grams & ~low | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[:len(key) - reach + width], key[reach - width:])
    start = _spread(np.cumsum(sizes) - sizes, windows)
    at = (key[start] & low).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), windows)
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    return grams[at[cut]], text[cut], start[cut], start[np.append(cut[1:], len(at)) - 1]


def _texts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of all rows, and per anchor its hash, row, first window start and number of windows; a long text comes in parts."""
    hashes, texts, row, parts, offset = _Hashes(), [], [], [], []
    for k, text in enumerate(values(batch.column("text"))):
        texts.append(text.split())
        if len(texts[-1]) >= length:
            numbers = np.fromiter(map(hashes.__getitem__, texts[-1]), np.uint64, len(texts[-1]))
            for a in range(0, len(numbers) - length + 1, PART_WORDS):
                row.append(k)
                offset.append(a)
                parts.append(numbers[a:a + PART_WORDS + length - 1])
    first = 0
    while first < len(parts):
        last, held = first, 0
        while last < len(parts) and (last == first or held + len(parts[last]) < PART_WORDS):
            held += len(parts[last])
            last += 1
        sizes = np.array([len(x) for x in parts[first:last]])
        h, text, start, stop = anchors(np.concatenate(parts[first:last]), sizes, length)
        moved = np.array(offset[first:last]) - (np.cumsum(sizes) - sizes)
        yield texts, h, np.array(row[first:last])[text], start + moved[text], stop - start + 1
        first = last


@F.arrow_udf(T.BinaryType())
def _packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts compressed, as they travel to both joins."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for texts in batches:
        yield pa.array([pack(t) for t in values(texts)], pa.binary())
    release()


def _unpacked(packed: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(t) for t in values(packed)], pa.large_binary())


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text", BLOCK_BYTES):
                for _, h, row, _, _ in _texts(batch, length):
                    order = np.lexsort((h, row))
                    h, row = h[order], row[order]
                    once = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
                    rows = pa.array(row[once])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(rows), batch.column("text_hash").take(rows), pa.array(h[once].view(np.int64))], names=[*_KEY, "anchor"])
        release()

    return run


_CONTEXTS = "key bigint, text_hash bigint, anchor bigint, context binary, start bigint, most bigint, words binary"


def _context_rows(length: int):
    """Texts with their shared anchors to rows of contexts.

    A row with ``start`` is where a document has a context; one with ``words``
    tells a context's words, anchor, least and greatest (``key``, ``most``)
    document number, once for all documents a task holds at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[bytes, list] = {}
        held = 0

        def tell() -> pa.RecordBatch:
            n = len(told)
            anchor, least, most, words = zip(*told.values())
            columns = (least, [None] * n, anchor, list(told), [None] * n, most, words)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_CONTEXT_NAMES)

        for whole in batches:
            for batch in pieces_of(whole, "text", PACKED_BYTES):
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", _unpacked(batch.column("text")))
                keys = batch.column("key").to_numpy()
                shared = [np.array(x, np.int64).view(np.uint64) for x in batch.column("shared").to_pylist()]
                owner = np.repeat(np.arange(len(shared)), [len(x) for x in shared])
                # One number per row and anchor; a rare equal number only adds a context.
                known = np.unique(mixed(owner.astype(np.uint64)) ^ np.concatenate([np.empty(0, np.uint64), *shared]))
                for texts, h, row, start, n in _texts(batch, length):
                    hit = np.flatnonzero(np.isin(mixed(row.astype(np.uint64)) ^ h, known))
                    names, anchor = [], h[hit].view(np.int64)
                    for k, key, x, a, m in zip(row[hit].tolist(), keys[row[hit]].tolist(), anchor.tolist(), start[hit].tolist(), n[hit].tolist()):
                        text = b" ".join(texts[k][a:a + m + length - 1])
                        name = _name(text)
                        names.append(name)
                        if (old := told.get(name)) is None:
                            told[name] = [x, key, key, text]
                            held += len(text)
                        elif key < old[1]:
                            old[1] = key
                        elif key > old[2]:
                            old[2] = key
                    rows, none = pa.array(row[hit]), pa.nulls(len(hit), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(rows), batch.column("text_hash").take(rows), none, pa.array(names, pa.binary()), pa.array(start[hit]),
                         none, pa.nulls(len(hit), pa.binary())], names=_CONTEXT_NAMES)
                    if held > FLUSH_BYTES:
                        yield tell()
                        told.clear()
                        held = 0
        if told:
            yield tell()
        told.clear()
        release()

    return run


def _name(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _windows(length: int):
    """Distinct contexts to the names and places of their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = r["words"].split()
                rows += [(_name(b" ".join(words[j:j + length])), r["context"], j, r["least"], r["most"]) for j in range(len(words) - length + 1)]
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["window", "context", "at", "least", "most"])

    return run


def _cut_windows(length: int):
    """Contexts with the places of windows to the windows themselves, as contexts of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = r["words"].split()
                rows += [(w["window"], w["least"], w["most"], b" ".join(words[w["at"]:w["at"] + length])) for w in r["windows"]]
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["context", "least", "most", "words"])

    return run


_FIRSTS = "context binary, firsts array<struct<at:bigint,first:bigint>>"


def _search_shard(length: int):
    """Index all contexts of a shard, stream them through it, and tell which windows an earlier document holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        least: list[int] = []
        most: list[int] = []
        sizes: list[int] = []
        parts, numbers = [np.empty(0, np.int64)], _Numbers()
        for batch in batches:
            for name, low, high, text in zip(*[values(batch.column(c)) for c in ("context", "least", "most", "words")]):
                # Several tasks may tell of a context.
                k = number.setdefault(name, len(least))
                if k < len(least):
                    least[k], most[k] = min(least[k], low), max(most[k], high)
                    continue
                least.append(low)
                most.append(high)
                words = text.split()
                sizes.append(len(words))
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        names, words = list(number), np.concatenate(parts)
        sizes, least, most = (np.array(x, np.int64) for x in (sizes, least, most))
        parts.clear()
        numbers.clear()
        if len(words):
            index = FmIndex(words, sizes, length)
            earliest = index.least_of_classes(least)
            matched, low, _ = index.matching_statistics(words, sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = _spread(np.zeros(len(sizes), np.int64), sizes)
            first = np.where(matched == length, earliest[index.class_of[np.minimum(low, index.size - 1)]], np.iinfo(np.int64).max)
            hit = np.flatnonzero(first < most[owner])
            owner, place, first = owner[hit], place[hit], first[hit]
            del index, matched, low, words
            cuts = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1])))
            ends = np.append(cuts[1:], len(owner))
            for i in range(0, len(cuts), 10_000):
                a, b = cuts[i:i + 10_000], ends[i:i + 10_000]
                offsets = np.concatenate((a, b[-1:])) - a[0]
                pairs = pa.StructArray.from_arrays([pa.array(place[a[0]:b[-1]]), pa.array(first[a[0]:b[-1]])], names=["at", "first"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[x] for x in owner[a].tolist()], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
                    names=["context", "firsts"])
        release()

    return run


def _span_rows(length: int):
    """Contexts of a document with the firsts of their windows to stretches of words to remove."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("firsts")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = lists.flatten()
            at, first = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            key, start = (batch.column(c).to_numpy() for c in ("key", "start"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero(first < key[row])
            row, place = row[hit], start[row[hit]] + at[hit]
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            # Windows that overlap or touch make one stretch.
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] > place[:-1] + length)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(row))[:len(begin)] - 1
            rows = pa.array(row[begin])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(rows), batch.column("text_hash").take(rows), pa.array(place[begin]), pa.array(place[end] + length)], names=[*_KEY, "from", "to"])

    return run


def _removed():
    names = ["n_words", "n_removed", "n_spans", "kept_sha256", "kept"]

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BinaryType()))]))
    def remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            unpack = zstandard.ZstdDecompressor().decompress
            for text, found in zip(values(texts), values(spans)):
                words = unpack(text).split()
                kept, at, n = [], 0, 0
                end = -1
                for a, b in sorted((s["from"], s["to"]) for s in found or []):
                    if a > end:
                        kept += words[at:a]
                        n += 1
                    at = end = max(end, b)
                kept += words[at:]
                rest = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), n, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        release()

    return remove


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, compressed, and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """``(context, firsts)``: the windows of each distinct context that an earlier document holds, with its number."""
    rows = contexts.where(F.col("words").isNotNull()).select("anchor", "context", F.col("key").alias("least"), "most", "words")
    windows = None
    # An anchor of which few contexts are told has few; only the others are counted again.
    many = rows.groupBy("anchor").count().where(F.col("count") > HOT_CONTEXTS)
    if not many.isEmpty():
        many = _written(rows.select("anchor", "context").distinct().groupBy("anchor").count().where(F.col("count") > HOT_CONTEXTS).select("anchor"), "anchors")
        if not many.isEmpty():
            hot = _written(rows.join(many, "anchor", "left_semi").groupBy("context").agg(
                F.min("least").alias("least"), F.max("most").alias("most"), F.first("words").alias("words")), "contexts")
            windows = _written(hot.mapInArrow(_windows(length), "window binary, context binary, at bigint, least bigint, most bigint"), "windows")
            # Only windows of several documents go on; their words are cut from one of the contexts that hold them.
            shared = windows.groupBy("window").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min(F.struct("context", "at")).alias("in"))
            shared = shared.where("least != most").groupBy(F.col("in.context").alias("context")).agg(
                F.collect_list(F.struct("window", "least", "most", "in.at")).alias("windows"))
            single = hot.select("context", "words").join(shared, "context").select("words", "windows").mapInArrow(
                _cut_windows(length), "context binary, least bigint, most bigint, words binary")
            single = single.select(F.xxhash64("context").alias("anchor"), "context", "least", "most", "words")
            rows = rows.join(many, "anchor", "left_anti").select("anchor", "context", "least", "most", "words").unionByName(single)
    # Several tasks may tell of a context, so this is no less than what the shards hold.
    size = rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    firsts = dealt.select("context", "least", "most", "words").mapInArrow(_search_shard(length), _FIRSTS)
    if windows is None:
        return firsts
    firsts = _written(firsts, "firsts")
    back = windows.select("window", "context", "at").join(firsts.select(F.col("context").alias("window"), F.col("firsts")[0]["first"].alias("first")), "window")
    # The name of a window of its own is that of no other context a document was found to hold, or of one with the same firsts.
    return firsts.unionByName(back.groupBy("context").agg(F.collect_list(F.struct("at", "first")).alias("firsts")))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row ``(id_col, n_words, n_removed, n_spans, kept_sha256, kept)``; ``kept`` are the remaining words joined by one blank.

    A word goes if a window of ``length`` words that covers it also starts in a
    row with a smaller integer identifier; a null one is smaller than all, and
    rows with the same identifier, repeated rows among them, do not remove each
    other's words. Null and empty texts have no words, a table without rows
    gives none, and other columns are not read. Words stand between blanks and
    the controls 9 to 13 and are compared as they are. A shard's index takes
    some hundred bytes a word, with some 1.5 million words in a shard.
    """
    texts = small_batches(docs).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    found = _written(texts.select(*_KEY, "text").mapInArrow(_anchor_rows(length), "key bigint, text_hash bigint, anchor bigint"), "anchors")
    # Written, so that the join below knows its size and sends it to the tasks only where it is small.
    shared = _written(found.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a != b").select("anchor"), "shared")
    own = found.join(shared, "anchor").groupBy(*_KEY).agg(F.collect_set("anchor").alias("shared"))
    contexts = _written(texts.select(*_KEY, _packed("text").alias("text")).join(own, _KEY).select(*_KEY, "text", "shared").mapInArrow(
        _context_rows(length), _CONTEXTS), "contexts")
    firsts = _shared_contexts(contexts, length)
    spans = contexts.where(F.col("start").isNotNull()).select(*_KEY, "context", "start").join(firsts, "context").select(*_KEY, "start", "firsts").mapInArrow(
        _span_rows(length), "key bigint, text_hash bigint, from bigint, to bigint")
    spans = spans.groupBy(*_KEY).agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    rows = texts.select("id", *_KEY, _packed("text").alias("text")).join(spans, _KEY, "left")
    return rows.select(F.col("id").alias(id_col), _removed()("text", "spans").alias("r")).select(id_col, "r.*")

"""Language-model scores from a probabilistic suffix tree over bytes.

A text is its words, lower-cased and parted by single blanks, and an end; a
symbol is a byte of that string. The tree holds contexts of up to DEPTH bytes,
across word borders. A context is kept if the distribution of the byte after
it diverges from that of its own suffix by more than the extra parameters are
worth. A byte is scored in the state of the longest kept suffix of what stands
before it; a state's counts are smoothed by its next shorter kept suffix, the
root's by the uniform distribution. So every text has a probability.

Every kept context is used. The states that occur most are sent to the tasks;
bytes that may have a longer state are looked up by a join with the others.

The base score is that of single words with add-half smoothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import held_out, pieces_of, release, shared_path, small_batches
from .hashing import Table, mixed

DEPTH = 5
END = b"\n"
#: Weight of the shorter suffix in a state's smoothing.
SMOOTHING = 2.0
#: A context's divergence must exceed PENALTY * distinct next bytes * ln(all bytes) / 2 nats.
PENALTY = 0.25
#: Most entries (context, byte) sent to the tasks, those of the states that occur most; all others are joined.
SENT_ENTRIES = 1_000_000
#: Bits of the filter that tells which states are not sent; more states only make more bytes be looked up.
FILTER_BITS = 27
#: Most words whose counts are sent to the tasks; the counts of all others are joined.
FREQUENT = 200_000
BLOCK_BYTES = 3_000_000
HELD_FOLDS = 5


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of DEPTH bytes before and the byte itself, for all bytes of all texts, and the bytes of each text."""
    data = np.frombuffer(b"".join(END * DEPTH + t + END for t in texts), np.uint8).astype(np.uint64)
    two = data[:-1] << np.uint64(8) | data[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    keys = four[:-2] << np.uint64(16) | two[4:]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    # Key i ends at byte i + DEPTH; those that end in the padding are left out.
    first = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    return keys[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: bytes with their contexts, and words; ends are counted as a null word."""
    words, grams, held = Counter(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if grams:
            keys, n = np.concatenate([k for k, _ in grams]), np.concatenate([c for _, c in grams])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.add.reduceat(n[order], first)
            for i in range(0, len(first), 100_000):
                part = keys[first[i:i + 100_000]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.binary()), pa.array(n[i:i + 100_000])], names=["gram", "word", "n"])
        listed = list(words.items())
        for i in range(0, len(listed), 100_000):
            part = listed[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], names=["gram", "word", "n"])
        words.clear()
        grams.clear()

    for whole in batches:
        for batch in pieces_of(whole, "text", BLOCK_BYTES):
            texts = [_words(t) for t in batch.column("text").to_pylist()]
            for t in texts:
                words.update(t)
            keys = np.sort(_stream([b" ".join(t) for t in texts])[0])
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            grams.append((keys[first], np.diff(np.append(first, len(keys)))))
            held += len(first)
            if held > 1_500_000 or len(words) > 400_000:
                yield from flush()
                held = 0
    yield from flush()
    release()


def _per_key(function, keys: np.ndarray) -> np.ndarray:
    """``function`` of an array, called on its distinct members; most bytes of a block repeat a context."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    values = function(ordered[first])
    out = np.empty(len(keys), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(first, len(keys))))
    return out


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def _entry(depth: int, grams: np.ndarray) -> np.ndarray:
    return grams & _mask(depth + 1) | np.uint64(depth + 1 << 56)


def _state(depth: int, contexts: np.ndarray) -> np.ndarray:
    return contexts & _mask(depth) | np.uint64(depth + 128 << 56)


def _filter_bits(states: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each state in a filter of ``size`` bits, a power of two."""
    hashes, low = mixed(states), np.uint64(size - 1)
    return (hashes & low).astype(np.int64), (hashes >> np.uint64(32) & low).astype(np.int64)


def _filter_places(size: int):
    """States to their places; Spark's bitmap functions count from 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, context = (batch.column(c).to_numpy().astype(np.uint64) for c in ("depth", "context"))
            places = _filter_bits(context | depth + np.uint64(128) << np.uint64(56), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places) + 1)], names=["place"])

    return run


@dataclass
class SuffixTree:
    """Log10 probabilities of entries, and of leaving a state for its shorter suffix; a filter of the states that are elsewhere."""

    root: np.ndarray
    table: Table
    elsewhere: np.ndarray | None = None

    FOUND = np.dtype([("log", np.float32), ("more", bool)])

    def look_up(self, grams: np.ndarray) -> np.ndarray:
        """``log10`` of every key, and whether it may have a longer state that is not here."""
        out = np.zeros(len(grams), self.FOUND)
        out["log"] = self.log10(grams)
        if self.elsewhere is not None:
            for d in range(1, DEPTH + 1):
                a, b = _filter_bits(_state(d, grams >> np.uint64(8)), 8 * len(self.elsewhere))
                out["more"] |= (self.elsewhere[a >> 3] >> (a & 7) & self.elsewhere[b >> 3] >> (b & 7) & 1).astype(bool)
        return out

    @classmethod
    def of(cls, depth: np.ndarray, gram: np.ndarray, n: np.ndarray, total: np.ndarray) -> SuffixTree:
        """From the kept entries: depth, context and byte as one key, count, and count of the context."""
        root = np.full(256, 0.5)
        top = depth == 0
        root[gram[top].astype(np.int64)] += n[top]
        tree = cls(np.log10(root / root.sum()).astype(np.float32), Table(np.empty(0, np.uint64), np.empty(0, np.float32)))
        keys, values = [], []
        for d in range(1, DEPTH + 1):
            mine = depth == d
            g, count, whole = gram[mine], n[mine], total[mine]
            if not len(g):
                continue
            shorter = 10.0 ** tree.log10(g, d - 1).astype(float)
            keys.append(_entry(d, g))
            values.append(np.log10((count + SMOOTHING * shorter) / (whole + SMOOTHING)))
            states, first = np.unique(g >> np.uint64(8), return_index=True)
            keys.append(_state(d, states))
            values.append(np.log10(SMOOTHING / (whole[first] + SMOOTHING)))
            tree.table = Table(np.concatenate(keys), np.concatenate(values).astype(np.float32))
        return tree

    def log10(self, grams: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Per key the log10 probability of its byte in the state of the longest kept suffix of at most ``depth`` bytes."""
        out, left = np.zeros(len(grams), np.float32), np.arange(len(grams))
        for d in range(depth, 0, -1):
            g = grams[left]
            value = self.table.get(_entry(d, g))
            found = ~np.isnan(value)
            out[left[found]] += value[found]
            left, g = left[~found], g[~found]
            out[left] += np.nan_to_num(self.table.get(_state(d, g >> np.uint64(8))))
        out[left] += self.root[(grams[left] & np.uint64(255)).astype(np.int64)]
        return out


def keep_contexts(grams: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """Contexts that pass the divergence test: ``depth, context, total, next`` (bytes and counts), ``gain`` and ``price``.

    ``grams`` is (gram, n). A context has at most 256 next bytes, so a row is
    bounded. The root is always kept.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth")
    cut = F.expr("gram & (shiftleft(1L, 8 * (depth + 1)) - 1)")
    counts = grams.select("gram", "n", levels).select("depth", cut.alias("gram"), "n").groupBy("depth", "gram").agg(F.sum("n").alias("n"))
    contexts = counts.groupBy("depth", F.shiftright("gram", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.collect_list(F.struct(F.col("gram").bitwiseAND(255).cast("int").alias("byte"), "n")).alias("next"))
    all_bytes = contexts.where("depth = 0").agg(F.sum("total")).first()[0] or 0
    price = F.size("next") * (penalty * math.log(max(all_bytes, 2)) / 2)
    # Fewer occurrences than this cannot diverge by the price of even two next bytes.
    contexts = contexts.where((F.col("depth") == 0) | (F.col("total") * math.log(256) > penalty * math.log(max(all_bytes, 2)) / 2))
    shorter = contexts.select(
        (F.col("depth") + 1).alias("depth"), F.col("context").alias("suffix"), F.col("total").alias("s_total"), F.map_from_entries("next").alias("s_next"))
    joined = contexts.withColumn("suffix", F.expr("context & (shiftleft(1L, 8 * greatest(depth - 1, 0)) - 1)")).join(shorter, ["depth", "suffix"], "left")
    gain = F.aggregate(
        "next", F.lit(0.0),
        lambda acc, x: acc + x["n"] * F.ln(x["n"] / F.col("total") / (F.element_at("s_next", x["byte"]) / F.col("s_total"))))
    return joined.withColumn("gain", gain).withColumn("price", price).where("depth = 0 or gain > price").select(
        "depth", "context", "total", "next", "gain", "price")


def learn_tree(grams: DataFrame, max_entries: int | None = None, penalty: float = PENALTY, sent: int = SENT_ENTRIES) -> tuple[SuffixTree, DataFrame | None]:
    """The tree of the counted bytes with at most ``sent`` entries besides the root's, and the other kept contexts if there are any.

    The kept contexts are written once. A state occurs no more often than its
    suffixes, so the states left out are longer than those sent with them. Only
    with ``max_entries`` the price of a context doubles until so many fit.
    """
    spark, path = grams.sparkSession, shared_path(grams.sparkSession, "contexts")
    keep_contexts(grams, penalty).write.parquet(path)
    kept, factor = spark.read.parquet(path), 1.0
    while max_entries is not None and (kept.where(f"depth = 0 or gain > {factor} * price").agg(F.sum(F.size("next"))).first()[0] or 0) > max_entries:
        factor *= 2
    kept = kept.where(f"depth = 0 or gain > {factor} * price").withColumn("class", F.floor(F.log2("total") * 8))
    held, least, others = 0, 0, None
    for r in sorted(kept.where("depth > 0").groupBy("class").agg(F.sum(F.size("next")).alias("n")).collect(), key=lambda r: -r["class"]):
        held += r["n"]
        if held > sent:
            least = r["class"] + 1
            others = kept.where(f"depth > 0 and class < {least}").select("depth", "context", "total", "next")
            break
    rows = kept.where(f"depth = 0 or class >= {least}").select("depth", "context", "total", F.explode("next").alias("x")).select(
        "depth", (F.shiftleft("context", 8).bitwiseOR(F.col("x.byte"))).alias("gram"), F.col("x.n").alias("n"), "total").toArrow()
    column = lambda c: rows.column(c).to_numpy()
    tree = SuffixTree.of(column("depth"), column("gram").view(np.uint64), column("n"), column("total"))
    if others is not None:
        tree.elsewhere = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        places = others.select("depth", "context").mapInArrow(_filter_places(1 << FILTER_BITS), "place bigint")
        for r in places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).toLocalIterator():
            bits = np.frombuffer(r["bits"], np.uint8)
            at = (r["bucket"] - 1) * len(bits)
            tree.elsewhere[at:at + len(bits)] = bits[:len(tree.elsewhere) - at]
    return tree, others


def longer_states(asked: DataFrame, others: DataFrame) -> DataFrame:
    """``(gram, log)`` for distinct ``(gram, log)``: the log10 probability in the sent states carried on through the other states, shortest first."""
    levels = asked.select("gram", F.explode(F.sequence(F.lit(1), F.lit(DEPTH))).alias("depth")).withColumn(
        "context", F.expr("shiftrightunsigned(gram, 8) & (shiftleft(1L, 8 * depth) - 1)"))
    n = F.coalesce(F.expr("get(filter(next, x -> x.byte = (gram & 255)), 0).n"), F.lit(0))
    states = levels.join(others, ["depth", "context"]).groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("depth", n.alias("n"), "total"))).alias("states"))
    p = F.aggregate("states", F.pow(F.lit(10.0), F.col("log")), lambda p, x: (x["n"] + SMOOTHING * p) / (x["total"] + SMOOTHING))
    return asked.join(states, "gram", "left").select("gram", F.when(F.col("states").isNull(), F.col("log")).otherwise(F.log10(p)).alias("log"))


def count_corpus(train: DataFrame, text_col: str = "text") -> DataFrame:
    """``(gram, word, n)`` over all texts, counted per task, added up by key and written once."""
    spark, path = train.sparkSession, shared_path(train.sparkSession, "counts")
    partial = train.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(_count, "gram bigint, word binary, n bigint")
    partial.groupBy("gram", "word").agg(F.sum("n").alias("n")).write.parquet(path)
    return spark.read.parquet(path)


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """The words with the largest counts, at most ``most``: all from a count on, so that no task sorts them.

    The count is found from a histogram of eight classes per doubling.
    """
    size = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for r in sorted(words.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        held += r["count"]
        if held > most:
            break
        least = r["size"]
    return words.where(F.lit(False) if least is None else size >= least)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = HELD_FOLDS,
                max_entries: int | None = None, frequent: int = FREQUENT, sent: int = SENT_ENTRIES) -> DataFrame:
    """Per row ``held_out, n_tokens, n_known, train_tokens, base_score, score``; learnt outside the held-out fold.

    A null text is empty: its only token is the end. Repeated rows are learnt
    from and scored each; null identifiers are learnt from. An empty table
    gives no rows, an empty training set uniform distributions.
    """
    spark: SparkSession = docs.sparkSession
    docs = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("held", held_out("id", folds))
    counts = count_corpus(docs.where(~F.col("held")))
    words = counts.where("word is not null").select("word", "n")
    # Ends are bytes too: each training text has one.
    ends = int(counts.where("gram & 255 = 10").agg(F.sum("n")).first()[0] or 0)
    distinct, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total += ends
    room = total + 0.5 * (distinct + (ends > 0) + 1)
    tree, longer = learn_tree(counts.where("gram is not null").select("gram", "n"), max_entries, sent=sent)
    top = frequent_words(words, frequent).toArrow()
    model = spark.sparkContext.broadcast((tree, top.column("word").to_pylist(), top.column("n").to_numpy()))
    log_room, end_score = math.log10(room), math.log10((ends + 0.5) / room)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, listed, n = model.value
        number = {w: i for i, w in enumerate(listed)}.get
        log_n = np.append(np.log10(n + 0.5) - log_room, 0.0)
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in pieces_of(whole, "text", BLOCK_BYTES):
                texts = [_words(t) for t in batch.column("text").to_pylist()]
                base, known, rare, times = [], [], [], []
                for t in texts:
                    at = np.fromiter(map(number, t, repeat(-1)), np.int64, len(t))
                    base.append(float(log_n[at].sum()) + end_score)
                    known.append(int((at >= 0).sum()) + (ends > 0))
                    others = Counter(t[i] for i in np.flatnonzero(at < 0).tolist())
                    rare.append(list(others))
                    times.append(list(others.values()))
                tokens = pa.array([len(t) + 1 for t in texts], pa.int64())
                texts = [b" ".join(t) for t in texts]
                keys, sizes = _stream(texts)
                found = _per_key(tree.look_up, keys)
                # Bytes that may have a longer state are left to the join: per text its distinct keys, how often, and what is known of them.
                more = np.flatnonzero(found["more"])
                owner = np.searchsorted(np.cumsum(sizes), more, side="right")
                order = np.lexsort((keys[more], owner))
                more, owner = more[order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (keys[more][1:] != keys[more][:-1])))[:len(more)])
                cuts = pa.array(np.searchsorted(owner[first], np.arange(len(texts) + 1)), pa.int32())
                asked = [keys[more[first]].view(np.int64), np.diff(np.append(first, len(more))), found["log"][more[first]].astype(float)]
                found["log"][more] = 0
                scores = np.add.reduceat(found["log"], np.cumsum(sizes) - sizes, dtype=float)
                del keys, found, more, owner, order, first
                rows = np.arange(row, row + len(texts))
                row += len(texts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows), batch.column("id"), batch.column("held"), tokens,
                    pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(rare, pa.list_(pa.binary())),
                    pa.array(times, pa.list_(pa.int64())), *[pa.ListArray.from_arrays(cuts, pa.array(x)) for x in asked],
                ], names=["row", "id", "held", "n_tokens", "known", "base", "score", "rare", "times", "grams", "gram_times", "gram_logs"])
            release()

    kind = docs.schema["id"].dataType.simpleString()
    path = shared_path(spark, "scored")
    docs.select("id", "held", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(
        score, f"row bigint, id {kind}, held boolean, n_tokens bigint, known bigint, base double, score double, rare array<binary>, times array<bigint>, "
        "grams array<bigint>, gram_times array<bigint>, gram_logs array<double>",
    ).write.parquet(path)
    scored = spark.read.parquet(path)
    others = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    added = others.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - log_room)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    if longer is not None:
        left = scored.select("row", F.explode(F.arrays_zip("grams", "gram_times", "gram_logs")).alias("x")).select(
            "row", F.col("x.grams").alias("gram"), F.col("x.gram_times").alias("times"), F.col("x.gram_logs").alias("log"))
        logs = longer_states(left.groupBy("gram").agg(F.max("log").alias("log")), longer)
        more = left.drop("log").join(logs, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
        scored = scored.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    return scored.drop("rare", "times").join(added, "row", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")

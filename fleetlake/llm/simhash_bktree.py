"""SimHash near-duplicates with BK-trees.

A fingerprint has a 1 where most shingle hashes have a 1. Two fingerprints
within ``radius`` bits agree on at least one of ``radius + 1`` blocks of bits,
so every distinct fingerprint is dealt to one shard per block. Those that share
a full block value are dealt again by blocks of the bits left. A shard holds
the BK-trees of its block values: children are keyed by the integer Hamming
distance to the parent, and a search from distance d follows only the edges
d - radius .. d + radius. Trees and searches meet by shuffle, because a
broadcast of all trees has no size bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import cut_lineage, raw, release, small_batches

SEED = 42
BITS = 64
#: Tree nodes, and searches, in one shard group; a block value with more members is split by further bits.
TREE_ROWS = 20_000
#: Times a block value is split by further bits; what is still full then becomes several trees, searched in slices.
LEVELS = 3
#: Rows of a shard, and (search, node) pairs held at once while searching.
SHARD_ROWS = 200_000
FRONTIER = 2_000_000


def fingerprint(text: bytes, words: int = 3) -> bytes:
    """Eight bytes, highest bit first: bits set in over half of the shingle hashes."""
    tokens = text.lower().split()
    if not tokens:
        return bytes(8)
    if len(tokens) < words:
        return xxhash.xxh64_digest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[words - 1:].tolist())
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), ">u8", n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 65_536):
        part = hashes[i:i + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def _fingerprints(words: int):
    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            digests = b"".join(fingerprint(t or b"", words) for t in raw(texts))
            yield pa.array(np.frombuffer(digests, ">u8").astype(np.uint64).view(np.int64))
        release()

    return prints


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp)`` per document; A-Z lower-cased, words split at ASCII white space."""
    return small_batches(docs).select(F.col(id_col).alias("id"), _fingerprints(words)(F.col(text_col)).alias("fp"))


class Forest:
    """BK-trees over 64-bit words, one per distinct ``tree`` value."""

    def __init__(self, tree: np.ndarray, words: np.ndarray):
        order = np.lexsort((words, tree))
        self.source, tree, self.words = order, tree[order], words[order]
        n = len(words)
        self.trees, self.roots = np.unique(tree, return_index=True)
        at = self.roots[np.searchsorted(self.trees, tree)]
        left = np.setdiff1d(np.arange(n), self.roots, assume_unique=True)
        edges = []
        while len(left):
            key = at[left] * (BITS + 1) + self.distance(self.words[left], at[left])
            keys, first, which = np.unique(key, return_index=True, return_inverse=True)
            child = left[first]
            edges.append((keys, child))
            rest = child[which] != left
            at[left[rest]] = child[which[rest]]
            left = left[rest]
        keys = np.concatenate([k for k, _ in edges] or [np.empty(0, np.int64)])
        child = np.concatenate([c for _, c in edges] or [np.empty(0, np.int64)])
        order = np.argsort(keys)
        self.keys, self.child = keys[order], child[order]

    def distance(self, words: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(words ^ self.words[nodes]).astype(np.int64)

    def search(self, tree: np.ndarray, words: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (search, node) within ``radius``, in blocks that bound the pairs held at once."""
        place = np.searchsorted(self.trees, tree)
        sizes = np.diff(np.append(self.roots, len(self.words)))[place]
        cuts, held = [0], 0
        for i, s in enumerate(sizes.tolist()):
            if held and held + s > FRONTIER:
                cuts.append(i)
                held = 0
            held += s
        for lo, hi in zip(cuts, [*cuts[1:], len(tree)]):
            search, node = np.arange(lo, hi), self.roots[place[lo:hi]]
            while len(search):
                d = self.distance(words[search], node)
                yield search[d <= radius], node[d <= radius]
                first = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(d - radius, 0))
                last = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
                n = last - first
                search = np.repeat(search, n)
                node = self.child[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of the pairs (a, b); a label is the smallest member."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while not np.array_equal(short := label[label], label):
            label[:] = short


def _shard_links(radius: int):
    def links(shard: pd.DataFrame) -> pd.DataFrame:
        _, tree = np.unique(shard[["key", "salt"]].to_numpy(), axis=0, return_inverse=True)
        words, role = shard["fp"].to_numpy().view(np.uint64), shard["role"].to_numpy()
        nodes = np.flatnonzero(role != 1)
        forest = Forest(tree[nodes], words[nodes])
        back = nodes[forest.source]
        searches = np.flatnonzero((role != 0) & np.isin(tree, forest.trees))
        same, node_of = np.unique(words, return_inverse=True)
        label = np.arange(len(same))
        for s, n in forest.search(tree[searches], words[searches], radius):
            unite(label, node_of[searches[s]], node_of[back[n]])
        moved = np.flatnonzero(label != np.arange(len(label)))
        release()
        return pd.DataFrame({"a": same[moved].view(np.int64), "b": same[label[moved]].view(np.int64)})

    return links


def link_fingerprints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` whose classes are those of all pairs of distinct ``fp`` within ``radius`` bits.

    A shard returns a spanning forest of what it links, so its output never
    exceeds its input. Members of a block value with over TREE_ROWS of them
    agree on a block of their other bits as well, so they are dealt by those,
    and so on. A value that is still full is cut into trees of TREE_ROWS nodes,
    each searched by slices of as many members, so no group is larger.
    """
    blocks, left, dealt = radius + 1, BITS, []
    rows = prints.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("bigint").alias("key"))
    for level in range(LEVELS + 1):
        width = -(-left // blocks)
        rows = rows.select("fp", "key", F.explode(_cuts(F.col("rest"), left, width)).alias("at")).select(
            "fp", F.xxhash64("key", "at.block", "at.value").alias("key"), "at.rest")
        left -= width
        sizes = cut_lineage(rows.groupBy("key").count().where("count > 1"))
        full = sizes.where(F.col("count") > TREE_ROWS)
        one = rows.join(sizes.where(F.col("count") <= TREE_ROWS).select("key"), "key")
        dealt.append(one.select("fp", "key", F.lit(0).alias("salt"), F.lit(2).alias("role")))
        if full.isEmpty():
            break
        rows = cut_lineage(rows.join(full, "key"))
        if level == LEVELS:
            dealt.append(_sliced(rows))
    rows = reduce(DataFrame.unionByName, dealt)
    shards = max(8, -(-blocks * prints.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "salt"), F.lit(shards)))
    return rows.groupBy("shard").applyInPandas(_shard_links(radius), "a long, b long")


def _cuts(rest: Column, left: int, width: int) -> Column:
    """Each block of the lowest ``left`` bits: its number, its value, and the other bits closed up."""
    out = []
    for i, low in enumerate(range(0, left, width)):
        here = min(width, left - low)
        value = F.shiftrightunsigned(rest, low).bitwiseAND((1 << here) - 1)
        above = F.shiftleft(F.shiftrightunsigned(rest, low + here), low) if low + here < BITS else F.lit(0).cast("bigint")
        other = rest.bitwiseAND((1 << low) - 1).bitwiseOR(above)
        # A narrower last block leaves more bits; the surplus ones are the same for all that share the block's number.
        out.append(F.struct(F.lit(i).alias("block"), value.alias("value"), other.alias("rest")))
    return F.array(*out)


def _sliced(rows: DataFrame) -> DataFrame:
    """Members of full keys, each in its tree for all slices, and as a search of its slice in all trees."""
    n = F.ceil(F.col("count") / TREE_ROWS).cast("int")
    tree, part = F.pmod(F.xxhash64("fp"), n).cast("int"), F.pmod(F.xxhash64(F.lit(1), "fp"), n).cast("int")
    each = F.sequence(F.lit(0), n - 1)
    nodes = F.transform(each, lambda k: F.struct((tree * n + k).alias("salt"), F.lit(0).alias("role")))
    searches = F.transform(each, lambda k: F.struct((k * n + part).alias("salt"), F.lit(1).alias("role")))
    return rows.select("fp", "key", F.explode(F.concat(nodes, searches)).alias("t")).select("fp", "key", "t.salt", "t.role")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """``(fp, root, component_id)`` per distinct fingerprint: its class and the smallest identifier in it."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = cut_lineage(components(link_fingerprints(distinct.select("fp"), radius)))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut_lineage(member.join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` per row: the smallest identifier reachable over links of ``radius`` bits.

    Null and empty texts have fingerprint zero and are linked like others.
    A null identifier keeps its row; it is no component's smallest unless all
    are null. Repeated rows repeat in the result, an empty table gives none.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words))
    return prints.join(_classes(prints, radius), "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, with its columns as they are: the one with the smallest identifier.

    A null identifier is kept only where its component has no other. Of rows
    with the same identifier and fingerprint one stays. The texts are shuffled
    once, by identifier; only rows whose identifier repeats are fingerprinted
    again and numbered.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words))
    first = prints.join(_classes(prints, radius), "fp").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("first"))
    first = cut_lineage(first.select(F.col("first.id").alias("__first_id"), F.col("first.fp").alias("__first_fp")))
    again = cut_lineage(prints.groupBy("id").count().where("count > 1 OR id IS NULL").select(F.col("id").alias("__again_id")))
    once = first.join(again, F.col("__first_id").eqNullSafe(F.col("__again_id")), "left_anti").select("__first_id")
    kept = docs.join(once, F.col(f"`{id_col}`") == F.col("__first_id"), "left_semi")
    if again.isEmpty():
        return kept
    row = docs.join(again, F.col(f"`{id_col}`").eqNullSafe(F.col("__again_id")), "left_semi").select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), _fingerprints(words)(F.col(f"`{text_col}`")).alias("fp"))
    row = row.join(first, row.id.eqNullSafe(first["__first_id"]) & (row.fp == first["__first_fp"]), "left_semi")
    number = F.row_number().over(Window.partitionBy("id", "fp").orderBy(F.lit(0)))
    return kept.unionByName(row.withColumn("number", number).where("number = 1").select("row.*"))

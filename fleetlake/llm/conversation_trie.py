"""Prefix trie of conversations, as balanced parentheses per shard.

Conversations are dealt to shards by ranges of their path (the hashes of their
turns in a row, then their number), so a shard holds a stretch of the trie. It
is encoded as parentheses: a node's closing bit bounds its subtree, leaves are
counted by rank, and sums over subtrees are differences of cumulative arrays.
Only nodes on the first or the last path of a shard can be in another shard as
well; these spines are merged by the hash of their path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage, release
from .parentheses import Parentheses, RangeLeast

#: Turns of a shard on average at most; a shard is a task.
SHARD_TURNS = 250_000
#: Conversation numbers in one row of a spine node's list.
PIECE = 1 << 16
HASH = 16
_WORDS = r"[^\x20\x09-\x0D]+"
_EMPTY = hashlib.sha256().hexdigest()
_ROW = {
    "kind": pa.int32(), "node": pa.binary(), "up": pa.binary(), "ups": pa.list_(pa.binary()), "conv_id": pa.int64(), "depth": pa.int64(),
    "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(),
    "words": pa.int64(), "ends_sha256": pa.string(), "ends": pa.binary()}
_ROW_TYPE = (
    "kind int, node binary, up binary, ups array<binary>, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string, ends binary")
_NODE, _SPINE, _ENDS = range(3)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: per conversation its turns in order, each with a hash of role and text and its number of words.

    Null turns come first, equal ones in order of role and hash, and repeated
    rows are turns of their own. A null role or text is empty. Rows without a
    conversation number belong to none and are left out. What is gathered per
    conversation is some 50 bytes a turn, not its texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(
        F.col(turn_col).alias("turn"), role.alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("hash"),
        F.regexp_count(text, F.lit(_WORDS)).cast("bigint").alias("words"))
    rows = convs.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), turn.alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def with_shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations with their first turns replaced by those of the first conversation of their group of numbers.

    How many, from none to ``most`` - 1, is told by the checksum of the number.
    A conversation may end up without turns.
    """
    c = F.col("conv_id")
    n = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = turns.where(c % group == 0).select(c.alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    rest = F.slice("turns", n + 1, F.greatest(F.size("turns") - n, F.lit(0)))
    head = F.when(n > 0, F.slice("_head", F.lit(1), F.greatest(n, F.lit(1))))
    own = turns.withColumn("_base", c - c % group)
    return own.join(heads, "_base", "left").select(c, F.concat(F.coalesce(head, F.slice("turns", 1, 0)), rest).alias("turns"))


class Trie:
    """The trie of conversations given in order of their paths; arrays are in pre-order."""

    def __init__(self, paths: list[bytes], words: list[list[int]]):
        bits, stack = bytearray(b"\x01"), [0]
        self.depth, self.words, self.parent, self.end = [0], [0], [-1], np.empty(len(paths), np.int64)
        before, first = b"", None
        for row, path in enumerate(paths):
            same, most = 0, min(len(path), len(before))
            if path == before:
                same = most
            while same < most and path[same:same + HASH] == before[same:same + HASH]:
                same += HASH
            same //= HASH
            bits += b"\x00" * (len(stack) - 1 - same)
            del stack[same + 1:]
            for d in range(same, len(path) // HASH):
                self.depth.append(d + 1)
                self.words.append(words[row][d])
                self.parent.append(stack[-1])
                stack.append(len(self.depth) - 1)
                bits += b"\x01"
            self.end[row], before = stack[-1], path
            first = first or list(stack)
        bits += b"\x00" * len(stack)
        self.first, self.last = first or [0], list(stack)
        self.depth, self.words, self.parent = (np.array(x, np.int64) for x in (self.depth, self.words, self.parent))
        self.tree = Parentheses(np.frombuffer(bytes(bits), np.uint8).astype(bool))
        self.opens = self.tree.opens()
        self.closes = self.tree.find_close(self.opens)
        nodes = np.arange(len(self.opens))
        self.stop = nodes + (self.closes - self.opens + 1) // 2

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sum over each node's subtree."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.stop] - total[:-1]

    def leaves(self) -> np.ndarray:
        return (self.tree.leaf_pairs(self.closes) - self.tree.leaf_pairs(self.opens)).astype(np.int64)

    def least(self, ids: np.ndarray) -> np.ndarray:
        """Smallest number of the conversations through each node."""
        own = np.full(len(self.opens), np.iinfo(np.int64).max)
        np.minimum.at(own, self.end, ids)
        return RangeLeast(own)(np.arange(len(own)), self.stop)


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _batch(**columns) -> pa.RecordBatch:
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c] if c in columns else [None] * n, t) for c, t in _ROW.items()], names=list(_ROW))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order of their paths to rows of nodes, of spine nodes and of the conversations that end at these."""
    ids, paths, words = [], [], []
    for batch in batches:
        ids += batch.column("conv_id").to_pylist()
        paths += batch.column("path").to_pylist()
        words += batch.column("words").to_pylist()
    if not ids:
        return
    ids, trie = np.array(ids, np.int64), Trie(paths, words)
    nodes = len(trie.opens)
    spine = np.zeros(nodes, bool)
    spine[trie.first] = spine[trie.last] = True
    n_convs = trie.below(np.bincount(trie.end, minlength=nodes))
    saved = (n_convs - 1) * trie.words
    leaf = trie.leaves()
    childless = trie.stop == np.arange(nodes) + 1
    # A spine node is whole only with its parts in other shards, so what spines add is left for their merge.
    saved_below, leaves = trie.below(np.where(spine, 0, saved)), leaf - trie.below(spine & childless)
    children = np.bincount(trie.parent[1:][~spine[1:]], minlength=nodes)
    conv = trie.least(ids)
    cuts = np.flatnonzero(np.concatenate(([True], trie.end[1:] != trie.end[:-1])))
    lists = dict(zip(trie.end[cuts].tolist(), np.split(ids, cuts[1:])))
    name = {}
    for row, path in ((trie.first, paths[0]), (trie.last, paths[-1])):
        name |= {k: hashlib.md5(path[:HASH * d]).digest() for d, k in enumerate(row)}
    own = np.flatnonzero(~spine)
    for i in range(0, len(own), 50_000):
        k = own[i:i + 50_000]
        up = trie.parent[k]
        yield _batch(
            kind=[_NODE] * len(k), up=[name.get(p) for p in up.tolist()], conv_id=conv[k], depth=trie.depth[k], parent_conv_id=conv[up], n_convs=n_convs[k],
            n_children=children[k], n_leaves=leaves[k], saved_tokens=saved_below[k],
            ends_sha256=[_sha(lists[x]) if x in lists else _EMPTY for x in k.tolist()])
    yield from _spines(trie, name, lists, conv, n_convs, children, leaves, saved_below)
    release()


def _spines(trie: Trie, name: dict[int, bytes], lists: dict, conv, n_convs, children, leaves, saved) -> Iterator[pa.RecordBatch]:
    above: dict[int, list[bytes]] = {}
    for k in sorted(name):
        up = int(trie.parent[k])
        above[k] = [*above[up], name[up]] if up >= 0 else []
        yield _batch(
            kind=[_SPINE], node=[name[k]], up=[name.get(up)], ups=[above[k]], conv_id=conv[k:k + 1], depth=trie.depth[k:k + 1], n_convs=n_convs[k:k + 1],
            n_children=children[k:k + 1], n_leaves=leaves[k:k + 1], saved_tokens=saved[k:k + 1], words=trie.words[k:k + 1])
        ends = lists.get(k, np.empty(0, np.int64))
        for i in range(0, len(ends), PIECE):
            yield _batch(kind=[_ENDS], node=[name[k]], conv_id=ends[i:i + 1], ends=[ends[i:i + PIECE].astype("<i8").tobytes()])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of node and first number to one digest a node; a long list is hashed piece by piece."""
    node, digest = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["node"] != node:
                if node is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])
                node, digest, comma = row["node"], hashlib.sha256(), ""
            digest.update((comma + ",".join(map(str, np.frombuffer(row["ends"], "<i8").tolist()))).encode())
            comma = ","
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def prefix_trie(turns: DataFrame, shards: int) -> DataFrame:
    """One row per distinct sequence of first turns of the conversations in ``turns`` (see ``turns_of``).

    Columns: ``conv_id``, the smallest of the ``n_convs`` conversations that
    start so; ``depth``; ``parent_conv_id`` (null for the root, which has no
    turns); ``n_children``; ``n_leaves`` of the subtree; ``saved_tokens``, the
    words a cache of common beginnings spares there; ``ends_sha256`` of the
    conversations that end here, joined by commas in ascending order.

    Equal sequences of hashes are one node. Conversations without turns end at
    the root; no conversations give no rows. A large group of equal
    conversations is dealt to many shards; the digest of its list is taken from
    packed pieces one after the other, as that checksum has to be.
    """
    t = F.col("turns")
    path = F.unhex(F.array_join(F.transform(t, lambda x: x["hash"]), ""))
    rows = turns.select("conv_id", path.alias("path"), F.transform(t, lambda x: x["words"]).alias("words"))
    rows = rows.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = cut_lineage(rows.mapInArrow(_shard, _ROW_TYPE))
    spines = found.where(F.col("kind") == _SPINE).groupBy("node").agg(
        F.first("up").alias("up"), F.first("ups").alias("ups"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.first("words").alias("words"))
    children = found.where((F.col("kind") == _SPINE) & F.col("up").isNotNull()).groupBy("up").agg(F.countDistinct("node").alias("more"))
    spines = cut_lineage(
        spines.join(children.withColumnRenamed("up", "node"), "node", "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    # What merged nodes add to every node above them, themselves included.
    added = spines.select(
        F.explode(F.concat("ups", F.array("node"))).alias("node"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf")).groupBy("node").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    digests = found.where(F.col("kind") == _ENDS).select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id")
    digests = digests.mapInArrow(_digests, "node binary, ends_sha256 string")
    parents = spines.select(F.col("node").alias("up"), F.col("conv_id").alias("above"))
    merged = spines.join(added, "node").join(digests, "node", "left").join(parents, "up", "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    own = found.where(F.col("kind") == _NODE).join(parents, "up", "left").select(
        *[F.coalesce("above", "parent_conv_id").alias(c) if c == "parent_conv_id" else F.col(c) for c in RESULT])
    return own.unionByName(merged)


def shards_for(convs: DataFrame, turns: int = SHARD_TURNS) -> int:
    """Shards for a table of turns: as many as there are shuffle partitions, more where they would hold over ``turns`` each."""
    return max(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-convs.count() // turns))

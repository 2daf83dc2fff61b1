"""Linked-list walks by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def follow(nodes: DataFrame, by: Sequence[str], node: str, prev: str) -> DataFrame:
    """For each node the head of its list and its place, from 1 at the head (``prev`` null).

    Every round joins each unfinished node with the node its pointer names and
    adds up the distances, so a chain of n nodes takes log2(n) rounds. A node
    whose chain has no head (a cycle, or a missing node) is not reached and not
    returned. A round writes out the open nodes and those it finished; the
    finished ones of earlier rounds stay in their files.
    """
    by = list(by)
    state = cut_lineage(nodes.select(
        *by, F.col(node).alias("_node"), F.col(prev).alias("_ptr"), F.col(node).alias("_head"),
        F.lit(1).cast("bigint").alias("_dist")))
    total, open_ = state.agg(F.count(F.lit(1)), F.count("_ptr")).first()
    rounds = ceil(log2(total + 1)) + 1 if total else 0
    done, left = state.filter(F.col("_ptr").isNull()), state.filter(F.col("_ptr").isNotNull())
    while open_ and rounds:
        hop = done.unionByName(left).select(
            *by, F.col("_node").alias("_ptr"), F.col("_ptr").alias("_next"), F.col("_head").alias("_far"), F.col("_dist").alias("_more"))
        moved = cut_lineage(
            left.drop("_head").join(hop, [*by, "_ptr"])
            .select(*by, "_node", F.col("_next").alias("_ptr"), F.col("_far").alias("_head"),
                    (F.col("_dist") + F.col("_more")).alias("_dist"))
        )
        done, left = done.unionByName(moved.filter(F.col("_ptr").isNull())), moved.filter(F.col("_ptr").isNotNull())
        open_ = left.agg(F.count("_ptr")).first()[0]
        rounds -= 1
    return done


def list_positions(nodes: DataFrame, by: Sequence[str], node: str, prev: str, name: str = "item") -> DataFrame:
    """Place of each node in its linked list."""
    return follow(nodes, by, node, prev).select(*by, F.col("_node").alias(node), F.col("_dist").alias(name))


def list_roots(nodes: DataFrame, node: str, prev: str, by: Sequence[str] = (), name: str = "root") -> DataFrame:
    """Head of the linked list each node belongs to."""
    return follow(nodes, by, node, prev).select(*by, F.col("_node").alias(node), F.col("_head").alias(name))

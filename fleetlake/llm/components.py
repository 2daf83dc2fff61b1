"""Connected components of a link table by alternating stars; no link or component passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(node, root)`` per node of a link; ``root`` is the smallest node reachable.

    Each round hangs the larger neighbours of a node on the smallest one, then
    all smaller neighbours likewise; the links are stars when a round changes
    nothing. Only minima are gathered per node, and they are written before
    the join so that a hot node's links are split by adaptive execution.
    Links with a null end and loops are ignored; no links give no rows.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = cut_lineage(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(high.alias("hi"), low.alias("lo")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut_lineage(
            both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = cut_lineage(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut_lineage(small.union(least.select("hi", "m")).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select("lo", "lo").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.crc32(F.concat_ws(",", "hi", "lo")))).first())

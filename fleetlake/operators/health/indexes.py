"""Index size, use and suspicion of missing indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.numbers import fmt_num, severity, size_pretty
from ..aggregates import table_traffic

# Verdict texts.
PRIORITIES = ["Minor Problem", "Major Problem", "Extreme Problem"]


def index_ratio(
    indexes: DataFrame, relations: DataFrame, on: Sequence[str] = ("relid",), index: str = "indexrelname",
    index_size: str = "index_bytes", table_size: str = "table_bytes", top: int | None = None,
) -> DataFrame:
    """Index size as a share of its table's; with ``top`` for the largest indexes, in order."""
    out = (
        indexes.select(*on, index, index_size)
        .join(relations.filter(F.col(table_size) > 0).select(*on, table_size), list(on))
        .select(
            *on, index,
            (F.floor(F.lit(100.0) * F.col(index_size) / F.col(table_size)) / F.lit(100.0)).alias("index_ratio"),
            F.col(index_size).alias("index_bytes"), size_pretty(index_size).alias("index_size"),
            size_pretty(table_size).alias("table_size"),
        )
    )
    return out if top is None else out.orderBy(F.col("index_bytes").desc(), index, *on).limit(top)


def missing_index(
    stats: DataFrame, rule: str = "scan_gap", size: str = "table_bytes", seq: str = "seq_scan", idx: str = "idx_scan",
    live: str = "n_live_tup", schema: str = "schemaname", name: str = "relname", min_size: int | None = None,
    min_rows: int = 10000, min_seq: int | None = None, top: int | None = None, keys: Sequence[str] = (),
    only_schema: str | None = None,
) -> DataFrame:
    """Tables read mostly without an index, by one of four rule sets.

    ``positive_gap``  used indexes, size over 80 000: is the surplus of full scans positive?
    ``scan_gap``      more full than index scans: minor, major or extreme by the surplus.
    ``two_percent``   index scans below 50 times the full scans, on tables of some size.
    ``scan_ratio``    share of full scans above 0.10 percent.

    The first two compare with a null scan count, so a table without any index
    is left out there; ``two_percent`` counts null as zero. ``only_schema``
    keeps the tables of one schema.
    """
    if only_schema is not None:
        stats = stats.filter(F.col(schema) == only_schema)
    s, i, bytes_ = F.col(seq), F.col(idx), F.col(size)
    base = [*keys, schema, name]
    if rule == "positive_gap":
        rows = stats.filter((bytes_ > (80000 if min_size is None else min_size)) & (i > 0))
        out = rows.select(
            *base, (s - i).alias("too_much_seq"),
            F.when(s - F.coalesce(i, F.lit(0)) > 0, F.lit("Missing Index ?")).otherwise(F.lit("OK")).alias("verdict"),
            bytes_.alias("rel_size"), seq, idx,
        )
        order = [F.col("too_much_seq").desc(), F.col("verdict"), *base]
    elif rule == "scan_gap":
        rows = stats.filter((s > i) & (s > (100 if min_seq is None else min_seq)) & (F.col(schema) != "pg_catalog"))
        out = rows.select(
            *base, F.concat_ws(".", schema, name).alias("table_in_trouble"), bytes_.alias("size_bytes"), seq, idx,
            severity(s - i, [500, 2500], PRIORITIES).alias("priority"),
        )
        order = [F.col("priority").desc(), s, *base]
    elif rule == "two_percent":
        rows = stats.filter(
            (s * 50 > F.coalesce(i, F.lit(0))) & (F.col(live) > min_rows)
            & (bytes_ > (1000000 if min_size is None else min_size)))
        out = rows.select(
            *base, fmt_num(seq).alias("total_seqscan"), fmt_num(idx).alias("total_indexscan"),
            fmt_num(live).alias("table_rows"), size_pretty(size).alias("table_size"), seq,
        )
        order = [s.desc(), *base]
    elif rule == "scan_ratio":
        rows = stats.filter(
            (bytes_ > (100000000 if min_size is None else min_size)) & (s > (500 if min_seq is None else min_seq)))
        share = F.floor(((s + 1) * 100) / (i + 1))
        out = rows.select(
            *base, seq, F.when(share > 0.10, F.lit("Missing Index Found"))
            .otherwise(F.lit("Missing Index Not Found")).alias("missing_index"),
            size_pretty(size).alias("table_size"), idx,
        )
        order = [F.col("missing_index"), s.desc(), *base]
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return out if top is None else out.orderBy(*order).limit(top)


def unused_indexes(
    indexes: DataFrame, tables: DataFrame, rule: str = "few_scans", on: Sequence[str] = ("relid",),
    index: str = "indexrelname", scans: str = "idx_scan", size: str = "index_bytes", unique: str = "is_unique",
    table_size: str = "table_bytes", max_scans: int = 50, min_table: int = 5 * 8192, top: int | None = None,
    reads: Sequence[str] = ("seq_scan", "table_idx_scan"), writes: Sequence[str] = ("n_tup_upd", "n_tup_ins", "n_tup_del"),
) -> DataFrame:
    """Non-unique indexes of little use.

    ``traffic``    each with its scans and its table's reads and writes.
    ``few_scans``  fewer than ``max_scans`` scans on a table of more than five
                   blocks, by bytes per scan; never-scanned indexes come first.
    """
    own = indexes.filter(~F.col(unique)).select(*on, index, F.col(scans).alias("index_scans"), F.col(size).alias("index_bytes"))
    if rule == "traffic":
        out = own.join(table_traffic(tables, reads, writes).select(
            *on, *reads, "table_reads_count", "table_writes_count", F.col(table_size).alias("table_bytes")), list(on))
        out = out.withColumns({"index_size": size_pretty("index_bytes"), "table_size": size_pretty("table_bytes")})
        order = [F.col("index_scans").desc_nulls_first(), F.col("index_bytes").desc(), F.col(index)]
    elif rule == "few_scans":
        large = tables.filter(F.col(table_size) > min_table).select(*on)
        per_scan = F.floor(F.try_divide(F.col("index_bytes").cast("double"), F.col("index_scans").cast("double")))
        out = (
            own.filter(F.col("index_scans") < max_scans).join(large, list(on))
            .withColumns({"bytes_per_scan": per_scan.cast("bigint"), "index_size": size_pretty("index_bytes")})
        )
        order = [F.col("bytes_per_scan").desc_nulls_first(), F.col("index_bytes").desc(), F.col(index)]
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return out if top is None else out.orderBy(*order).limit(top)


def index_usage(
    tables: DataFrame, indexes: DataFrame, on: Sequence[str] = ("relid",), name: str = "relname",
    rows: str = "n_live_tup", table_size: str = "table_bytes", index: str = "indexrelname", size: str = "index_bytes",
    unique: str = "is_unique", counters: dict[str, str] | None = None, top: int | None = None,
) -> DataFrame:
    """Every table with its indexes and their use; a table without index has one row."""
    counters = counters or {"idx_scan": "number_of_scans"}
    own = indexes.select(*on, F.col(index).alias("index_name"), F.col(size).alias("_size"), F.col(unique).alias("_unique"),
                         *[F.col(c).alias(a) for c, a in counters.items()])
    out = tables.join(own, list(on), "left").select(
        *on, name, "index_name", F.col(rows).alias("num_rows"), size_pretty(table_size).alias("table_size"),
        size_pretty("_size").alias("index_size"),
        F.when(F.col("_unique"), F.lit("Y")).otherwise(F.lit("N")).alias("unique"), *counters.values(),
    )
    if top is None:
        return out
    return out.orderBy(F.col("num_rows").desc_nulls_first(), name, *on, F.col("index_name")).limit(top)


def index_hit_rate(
    tables: DataFrame, name: str = "relname", idx: str = "idx_scan", seq: str = "seq_scan", live: str = "n_live_tup",
    digits: int = 5, keys: Sequence[str] = (),
) -> DataFrame:
    """Percent of a table's scans that used an index; null when none did."""
    pct = F.try_divide(F.lit(100.0) * F.col(idx), (F.col(seq) + F.col(idx)).cast("double"))
    return tables.select(
        *keys, name, F.when(F.col(idx) != 0, F.round(pct, digits)).alias("percent_of_times_index_used"),
        F.col(live).alias("rows_in_table"))


def invalid_indexes(indexes: DataFrame, valid: str = "is_valid", keep: Sequence[str] = ("relid", "indexrelname")) -> DataFrame:
    return indexes.filter(~F.col(valid)).select(*keep)

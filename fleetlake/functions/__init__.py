"""Column functions; every one is a JVM expression without a UDF."""

from .documents import extract_paths, get_paths, xml_int
from .identity import enum_rank, is_primary, match_tags, split_identifier
from .numbers import bytes_text, bytes_to, fmt_num, ratio, severity, size_pretty
from .positions import lsn_diff, lsn_number
from .settings import explode_options, option_or_default
from .text import (
    mentions_table, not_similar, parse_sequence_default, quote_ident, quote_literal,
    regex_filter, remediation, similar_regex, text_filter,
)
from .times import chunk_bound, delay_text, fmt_ts, fresh, seconds_between, slice_name, slice_time, stale

__all__ = [
    "bytes_text", "bytes_to", "chunk_bound", "delay_text", "enum_rank", "explode_options",
    "extract_paths", "fmt_num", "fmt_ts", "fresh", "get_paths", "is_primary", "lsn_diff",
    "lsn_number", "match_tags", "mentions_table", "not_similar", "option_or_default",
    "parse_sequence_default", "quote_ident", "quote_literal", "ratio", "regex_filter",
    "remediation", "seconds_between", "severity", "similar_regex", "size_pretty", "slice_name",
    "slice_time", "split_identifier", "stale", "text_filter", "xml_int",
]

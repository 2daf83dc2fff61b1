"""Structured Streaming: slices, replay, and rates."""

from .apply import apply_stream, compact, current_state
from .once import read_once, store_once, stream_once
from .rate import change_rate, deduplicated
from .readings import live_trend
from .slices import read_broker, write_slices
from .tables import StoredTable, apply_batch, apply_tables, compact_table, create_table, read_table

__all__ = [
    "StoredTable", "apply_batch", "apply_stream", "apply_tables", "change_rate", "compact", "compact_table", "create_table", "current_state",
    "deduplicated", "live_trend", "read_broker", "read_once", "read_table", "store_once", "stream_once", "write_slices",
]

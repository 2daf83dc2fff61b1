"""Sources and sinks."""

from .change_log import read_change_log, write_change_log
from .findings import findings, read_findings, render_rows, write_findings, write_tree
from .inventory import read_inventory, write_inventory
from .key_value import kv_scan, read_items
from .line_index import index_lines, read_lines_indexed
from .lines import read_lines_from
from .operations import OPS_SCHEMA, read_ops
from .snapshots import candidate_databases, fan_out, land_snapshot, read_snapshots
from .targets import cursor_rows, land_targets, read_landed, read_targets

__all__ = [
    "OPS_SCHEMA", "candidate_databases", "cursor_rows", "fan_out", "findings", "index_lines", "kv_scan", "land_snapshot", "land_targets", "read_change_log",
    "read_findings", "read_inventory", "read_items", "read_landed", "read_lines_from", "read_lines_indexed", "read_ops", "read_snapshots", "read_targets",
    "render_rows", "write_change_log",
    "write_findings", "write_inventory", "write_tree",
]

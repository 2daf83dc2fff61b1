"""Fleet-health reports, composed of the general operators."""

from .audits import class_drift, int_exhaustion, retention_audit, txid_age, txid_limit
from .bloat import bloat
from .indexes import index_hit_rate, index_ratio, index_usage, invalid_indexes, missing_index, unused_indexes
from .listings import (
    collection_stats, connections, database_sizes, instances, maintenance_windows, non_admin_databases, table_sizes,
)
from .maintenance import dead_rows, maintenance_due, vacuum_progress
from .replication import catch_up, slot_lag, standby_lag, subscription_status
from .statements import costs_by_call, statement_costs

__all__ = [
    "bloat", "catch_up", "class_drift", "collection_stats", "connections", "costs_by_call", "database_sizes",
    "dead_rows", "index_hit_rate", "index_ratio", "index_usage", "instances", "int_exhaustion", "invalid_indexes",
    "maintenance_due", "maintenance_windows", "missing_index", "non_admin_databases", "retention_audit",
    "slot_lag", "standby_lag", "statement_costs", "subscription_status", "table_sizes", "txid_age", "txid_limit",
    "unused_indexes", "vacuum_progress",
]

"""Fixed values the fleet's conventions prescribe."""

# Databases that belong to the server, not to an application.
SYSTEM_DATABASES = ["rdsadmin", "template1", "template0", "postgres"]
INACTIVE_DATABASE_PATTERN = "rdsadmin|template%|postgres|%delete_me"
SERVICE_OWNER_PATTERN = "dba_%|%delete_me"
EXPECTED_ROLE_PATTERN = "postgres|dba_%|rds%|dms%"
DOCUMENT_SYSTEM_DATABASES = ["admin", "config", "local"]
# The same by the fleet's scripts, which test for a part of the name and misspell one.
DOCUMENT_SYSTEM_DATABASE_REGEX = "admin|Cnfig|local"
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]
REPLICATION_SCHEMAS = ["pglogical", "pg_catalog", "information_schema"]

# Instance sizes in ascending order.
INSTANCE_SIZES = [
    "small", "medium", "large", "xlarge", "2xlarge", "4xlarge",
    "8xlarge", "12xlarge", "16xlarge", "18xlarge", "24xlarge",
]

# Backup retention minimum in days by engine.
MIN_RETENTION_DAYS = {
    "aurora": 6, "docdb": 1, "mysql": 6, "neptune": 1,
    "postgres": 6, "aurora-mysql": 6, "default": 1,
}

# Engines whose primary is told by the cluster's writer flag,
# and engines whose primary is told by the absence of a replica source.
CLUSTER_ENGINES = ["docdb", "aurora", "aurora-mysql", "aurora-postgres"]
SINGLE_ENGINES = ["postgres", "mysql"]

# Largest value of each integer type.
INTEGER_LIMITS = {"integer": 2147483647, "bigint": 9223372036854775807}

# Metric names, the reading assumed when a sample is missing,
# and the default gate limits of the online copy.
METRICS = [
    "CPUUtilization", "DiskQueueDepth", "BurstBalance",
    "ReadLatency", "WriteLatency", "OldestReplicationSlotLag",
]
MISSING_METRIC = {
    "CPUUtilization": -1.0, "DiskQueueDepth": -1.0, "BurstBalance": 100.0,
    "ReadLatency": 0.0, "WriteLatency": 0.0, "OldestReplicationSlotLag": 0.0,
}
COPY_LIMITS = {
    "max_cpu": 60.0, "max_disk_queue": 30.0, "min_burst_balance": 80.0,
    "max_read_latency": 0.02, "max_write_latency": 0.08, "max_slot_lag_gb": 100.0,
}

# Fields of an inventory line, in order.
INVENTORY_FIELDS = [
    "country", "instance_module", "instance_alias", "instance_name", "instance_endpoint",
    "instance_cname", "instance_port", "instance_tunnel_port", "instance_role",
]

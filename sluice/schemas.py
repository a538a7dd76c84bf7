"""The nine configuration tables, their keys, vocabularies and the connector registry.

Canonical storage types: ids and counters ``bigint``, flags ``boolean``, stamps
``timestamp_ntz`` holding UTC wall-clock time (no session-zone dependence), JSON and
comma-separated lists as ``string`` text decoded on read.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

ID = LongType()
TEXT = StringType()
FLAG = BooleanType()
TIME = TimestampNTZType()

# Column tail shared by every table.
COMMON_TAIL = [
    ("env_type", TEXT),
    ("is_active", FLAG),
    ("created_by", TEXT),
    ("created_at", TIME),
    ("updated_by", TEXT),
    ("updated_at", TIME),
]


def _table(cols: list[tuple]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in [*cols, *COMMON_TAIL]])


TABLES: dict[str, StructType] = {
    "conn_master": _table([
        ("connection_id", ID), ("connection_name", TEXT), ("connection_type", TEXT),
        ("connection_domain_name", TEXT), ("is_target", FLAG),
    ]),
    "connection_details": _table([
        ("connection_details_id", ID), ("connection_id", ID), ("connection_property_id", ID),
        ("connection_property", TEXT), ("connection_property_value", TEXT),
    ]),
    "connection_auth": _table([
        ("connection_auth_id", ID), ("connection_id", ID), ("auth_property_id", ID),
        ("auth_property", TEXT), ("auth_property_value", TEXT),
    ]),
    "tbl_source_table": _table([
        ("table_config_id", ID), ("connection_source_id", ID), ("connection_domain_name", TEXT),
        ("config_group", TEXT), ("source_attributes", TEXT), ("target_attributes", TEXT),
        ("load_type", TEXT), ("natural_key_columns", TEXT), ("hash_key_column", TEXT),
        ("partition_columns", TEXT), ("watermark_enabled", FLAG), ("pii_scan_enabled", FLAG),
        ("fail_mode", TEXT), ("retry_count", ID), ("ingestion_frequency", TEXT), ("tags", TEXT),
    ]),
    "tbl_watermark": _table([
        ("watermark_id", ID), ("table_config_id", ID), ("watermark_column", TEXT),
        ("watermark_type", TEXT), ("last_value", TEXT), ("last_run_id", TEXT),
    ]),
    "tbl_schema_version": _table([
        ("version_id", ID), ("table_config_id", ID), ("version_number", ID), ("column_count", ID),
        ("column_changes_json", TEXT), ("change_type", TEXT), ("detected_by_run_id", TEXT),
    ]),
    "tbl_pii_attribute": _table([
        ("pii_id", ID), ("table_config_id", ID), ("column_name", TEXT), ("pii_category", TEXT),
        ("protection_method", TEXT), ("sensitivity", TEXT), ("masking_policy", TEXT),
        ("uc_tag_applied", FLAG), ("access_tier", TEXT),
    ]),
    "aud_table_run": _table([
        ("table_run_id", ID), ("run_id", TEXT), ("table_config_id", ID), ("connection_source_id", ID),
        ("connection_target_id", ID), ("source_attributes", TEXT), ("target_attributes", TEXT),
        ("batch_id", TEXT), ("load_type", TEXT), ("start_time", TIME), ("end_time", TIME),
        ("elapsed_seconds", ID), ("rows_read", ID), ("rows_written", ID), ("watermark_start", TEXT),
        ("watermark_end", TEXT), ("status", TEXT), ("error_message", TEXT), ("error_type", TEXT),
    ]),
    "bts_config": _table([
        ("bts_config_id", ID), ("dataset_name", TEXT), ("source_config_id", ID), ("silver_layout", TEXT),
        ("dq_rules", TEXT), ("std_rules", TEXT), ("transformation_yaml", TEXT), ("tags", TEXT),
    ]),
}

# ---- fixed values that must equal the reference's: cascade order and parent columns ----
# Children soft-deleted with a pipeline config, in the order the cascade touches them.
CASCADE_CHILDREN = [
    ("tbl_watermark", "table_config_id"),
    ("tbl_schema_version", "table_config_id"),
    ("tbl_pii_attribute", "table_config_id"),
    ("aud_table_run", "table_config_id"),
    ("bts_config", "source_config_id"),
]

# ---- fixed values that must equal the reference's vocabularies ----
LOAD_TYPES = ["full", "incremental", "cdc", "api", "file_autoloader"]
FAIL_MODES = ["halt", "skip", "quarantine"]
WATERMARK_TYPES = ["timestamp", "integer", "hashkey"]
PROTECTION_METHODS = ["ENCRYPT", "MASK", "PSEUDONYMIZE", "REDACT"]
ACCESS_TIERS = ["PUBLIC", "INTERNAL", "RESTRICTED", "HIGHLY_RESTRICTED"]

# ---- fixed values: error codes carried as column values ----
INVALID_CONNECTOR_TYPE = "INVALID_CONNECTOR_TYPE"
INVALID_AUTH_TYPE = "INVALID_AUTH_TYPE"
INVALID_LOAD_TYPE = "INVALID_LOAD_TYPE"
MISSING_REQUIRED_FIELD = "MISSING_REQUIRED_FIELD"
INVALID_SOURCE_ATTRIBUTES = "INVALID_SOURCE_ATTRIBUTES"
DUPLICATE_CONNECTION_NAME = "DUPLICATE_CONNECTION_NAME"
CONNECTION_NOT_FOUND = "CONNECTION_NOT_FOUND"
PIPELINE_CONFIG_NOT_FOUND = "PIPELINE_CONFIG_NOT_FOUND"

DEFAULT_ACTOR = "system"

# ---- fixed values: connector registry (connector, label, base fields, defaults, auth methods) ----
CONNECTOR_REGISTRY = [
    ("mssql", "MSSQL", ["host", "port", "database", "schema", "odbc_driver"], {"port": "1433"}, ["basic", "kerberos", "oauth"]),
    ("postgres", "PostgreSQL", ["host", "port", "database", "schema"], {"port": "5432"}, ["basic", "iam"]),
    ("mysql", "MySQL", ["host", "port", "database"], {"port": "3306"}, ["basic"]),
    ("oracle", "Oracle", ["host", "port", "service_name", "schema"], {"port": "1521"}, ["basic", "kerberos"]),
    ("snowflake", "Snowflake", ["account_identifier", "warehouse", "database", "schema", "role"], {}, ["basic", "oauth", "key"]),
    ("bigquery", "BigQuery", ["project_id", "dataset", "location"], {}, ["iam", "oauth", "key"]),
    ("redshift", "Redshift", ["cluster_endpoint", "port", "database", "schema"], {"port": "5439"}, ["basic", "iam"]),
    ("s3", "S3", ["bucket_name", "region", "path_prefix"], {}, ["iam", "key"]),
    ("gcs", "GCS", ["bucket_name", "project_id", "path_prefix"], {}, ["iam", "key"]),
    ("azure-blob", "Azure Blob", ["storage_account_name", "container_name", "blob_path_prefix"], {}, ["key", "oauth"]),
    ("sftp", "SFTP", ["host", "port", "remote_path"], {"port": "22"}, ["basic", "key"]),
    ("local", "Local", ["base_path"], {}, ["none"]),
]

# ---- fixed values: fields each auth method needs ----
AUTH_FIELDS = {
    "none": [],
    "basic": ["username", "password"],
    "kerberos": ["principal", "keytab_path"],
    "oauth": ["client_id", "client_secret", "token_url"],
    "iam": ["iam_credentials"],
    "key": ["api_key"],
}


def table_schema(name: str) -> StructType:
    return TABLES[name]


def column_names(name: str) -> list[str]:
    return [f.name for f in TABLES[name].fields]

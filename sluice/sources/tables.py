"""Driver tables and configuration-table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.schemas import TABLES
from sluice.session import work_path

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the Parquet scan through Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A configuration table snapshot, read with its registered schema (partition columns
    of a partitioned snapshot are recovered from the directory names)."""
    return spark.read.schema(TABLES[name]).parquet(path).select(*TABLES[name].fieldNames())


def write_snapshot(df: DataFrame, spark: SparkSession, name: str, path: str | None = None,
                   partition_by: list[str] | None = None) -> str:
    """Write a new snapshot to a fresh path (a path being read is never overwritten).
    ``partition_by`` (e.g. env_type for a large run audit) lets readers that filter on it
    skip whole directories."""
    path = path or work_path(spark, name)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path

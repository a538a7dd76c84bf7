"""Lenses: projections that give driver tables the shape of configuration tables, so the
operators run over data that grows with the scale factor. Each lens is a plain select on
one driver table, so pruning and pushdown reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.tables import read_table

E = F.expr


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit runs from ``events``: open runs (signup) have no end_time, errors fail,
    every seventh run with at least one row loses a row."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("table_run_id"),
        E("concat('run_', CAST(event_id % 997 AS STRING))").alias("run_id"),
        F.col("user_id").alias("table_config_id"),
        E("user_id % 25").alias("connection_source_id"),
        F.col("ts").alias("start_time"),
        E("CASE WHEN event_type = 'signup' THEN NULL ELSE timestampadd(SECOND, CAST(event_id % 600 AS INT), ts) END").alias("end_time"),
        E("CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'succeeded' END").alias("status"),
        E("CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'connection' "
          "WHEN event_id % 3 = 1 THEN 'dq' ELSE 'timeout' END").alias("error_type"),
        E("CAST(floor(value * 10) AS BIGINT)").alias("rows_read"),
        E("CAST(floor(value * 10) AS BIGINT) - CASE WHEN event_id % 7 = 0 AND value >= 1 THEN 1 ELSE 0 END").alias("rows_written"),
        E("CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'qa' ELSE 'prod' END").alias("env_type"),
        E("event_id % 10 <> 0").alias("is_active"),
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline configs from ``customer``: one bad load type, three of five bad source shapes."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("table_config_id"),
        F.col("c_nationkey").cast("long").alias("connection_source_id"),
        F.lower("c_mktsegment").alias("connection_domain_name"),
        E("concat('grp_', CAST(c_custkey % 7 AS STRING))").alias("config_group"),
        E("""CASE c_custkey % 5 WHEN 0 THEN '{"schema":"main","table":"orders"}' WHEN 1 THEN '{"schema":"missing_table"}'
             WHEN 2 THEN '{"file_path":"/in","file_type":"csv"}' WHEN 3 THEN '{"file_path":null}'
             ELSE '{"schema":"","table":"t"}' END""").alias("source_attributes"),
        E("""CASE c_custkey % 7 WHEN 0 THEN 'full' WHEN 1 THEN 'incremental' WHEN 2 THEN 'cdc' WHEN 3 THEN 'api'
             WHEN 4 THEN 'file_autoloader' WHEN 5 THEN 'full' ELSE 'bogus' END""").alias("load_type"),
        E("CASE c_custkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'adhoc' END").alias("ingestion_frequency"),
        E("""CASE c_custkey % 3 WHEN 0 THEN '["pii","finance"]' WHEN 1 THEN '[]' ELSE NULL END""").alias("tags"),
        E("CASE c_custkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'qa' ELSE 'prod' END").alias("env_type"),
        E("c_custkey % 10 <> 0").alias("is_active"),
        F.col("c_custkey").alias("request_seq"),
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection requests from ``supplier``: repeated names, an unknown connector
    (sqlite) and invalid auth pairs."""
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("connection_id"),
        E("concat('conn_', CAST(s_suppkey % 40 AS STRING))").alias("connection_name"),
        E("CASE s_suppkey % 6 WHEN 0 THEN 'postgres' WHEN 1 THEN 'mssql' WHEN 2 THEN 's3' WHEN 3 THEN 'local' "
          "WHEN 4 THEN 'snowflake' ELSE 'sqlite' END").alias("connection_type"),
        E("CASE s_suppkey % 5 WHEN 0 THEN 'basic' WHEN 1 THEN 'kerberos' WHEN 2 THEN 'iam' WHEN 3 THEN 'none' ELSE 'key' END").alias("auth_type"),
        E("concat('domain_', CAST(s_nationkey AS STRING))").alias("connection_domain_name"),
        E("s_suppkey % 4 = 0").alias("is_target"),
        E("CASE s_suppkey % 2 WHEN 0 THEN 'dev' ELSE 'prod' END").alias("env_type"),
        E("s_suppkey % 10 <> 0").alias("is_active"),
        F.col("s_suppkey").alias("request_seq"),
    )


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection details EAV from ``supplier``, with on purpose a NULL value, a repeated
    key, an inactive row and a NULL key."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    prop = lambda n, name, value, active: F.struct(
        F.lit(n).cast("long").alias("connection_property_id"), F.lit(name).cast("string").alias("connection_property"),
        value.cast("string").alias("connection_property_value"), active.alias("is_active"))
    yes = F.lit(True)
    rows = F.array(
        prop(1, "host", F.col("s_name"), yes),
        prop(2, "port", E("CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '5432' END"), yes),
        prop(3, "host", F.lit("override"), E("s_suppkey % 2 = 0")),
        prop(4, None, F.lit("ignored"), yes),
    )
    return s.select(F.col("s_suppkey").alias("connection_id"), F.explode(rows).alias("_p")).select("connection_id", "_p.*")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema-version requests from ``orders``."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("table_config_id"),
        F.col("o_orderkey").alias("request_seq"),
        E("CASE WHEN o_orderstatus = 'P' THEN 'deletion' ELSE 'additive' END").alias("change_type"),
        F.col("o_orderdate").alias("created_at"),
        E("o_orderkey % 10 <> 0").alias("is_active"),
    )


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One watermark per config from ``events`` before 2024-01-15."""
    ev = read_table(spark, sf_dir, "events")
    return (
        ev.filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
        .groupBy(F.col("user_id").alias("table_config_id"))
        .agg(F.max("event_id").alias("watermark_id"), F.max("ts").alias("last_value"))
        .select("watermark_id", "table_config_id", F.lit("ts").alias("watermark_column"),
                F.lit("timestamp").alias("watermark_type"), "last_value")
    )

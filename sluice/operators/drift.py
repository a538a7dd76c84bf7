"""Schema drift (R14): compare (config, column, type) sets of two observations and
produce the change record that feeds D34."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def schema_rows(spark: SparkSession, schemas: dict, config_col: str = "table_config_id") -> DataFrame:
    """(config, column_name, data_type) rows from DataFrame schemas keyed by config id."""
    rows = [(cfg, f.name, f.dataType.simpleString()) for cfg, st in schemas.items() for f in (st.fields if isinstance(st, StructType) else st)]
    return spark.createDataFrame(rows, f"{config_col} long, column_name string, data_type string")


def detect_drift(old: DataFrame, new: DataFrame, config_col: str = "table_config_id") -> DataFrame:
    """Per config the added, removed and type-changed columns (sorted), the new
    column_count, change_type (deletion if any removed, else additive if any added, else
    modified) and the JSON change record. Configs without a change are left out.

    One full outer join on (config, column); the per-config lists hold at most one entry
    per column of that config's schema.
    """
    o = old.select(F.col(config_col).alias("_cfg_o"), F.col("column_name").alias("_col_o"), F.col("data_type").alias("_type_o"))
    n = new.select(F.col(config_col).alias("_cfg_n"), F.col("column_name").alias("_col_n"), F.col("data_type").alias("_type_n"))
    j = o.join(n, (o["_cfg_o"] == n["_cfg_n"]) & (o["_col_o"] == n["_col_n"]), "full_outer")
    j = j.select(
        F.coalesce("_cfg_n", "_cfg_o").alias(config_col),
        F.coalesce("_col_n", "_col_o").alias("column_name"),
        F.col("_col_o").isNull().alias("_added"),
        F.col("_col_n").isNull().alias("_removed"),
        (F.col("_col_o").isNotNull() & F.col("_col_n").isNotNull() & (F.col("_type_o") != F.col("_type_n"))).alias("_changed"),
        F.col("_col_n").isNotNull().alias("_present"),
    )
    per = j.groupBy(config_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("_added"), F.col("column_name")))).alias("added"),
        F.array_sort(F.collect_list(F.when(F.col("_removed"), F.col("column_name")))).alias("removed"),
        F.array_sort(F.collect_list(F.when(F.col("_changed"), F.col("column_name")))).alias("type_changed"),
        F.count_if(F.col("_present")).cast("long").alias("column_count"),
    )
    per = per.filter((F.size("added") + F.size("removed") + F.size("type_changed")) > 0)
    return per.withColumns({
        "change_type": F.when(F.size("removed") > 0, F.lit("deletion")).when(F.size("added") > 0, F.lit("additive")).otherwise(F.lit("modified")),
        "column_changes_json": F.to_json(F.struct("added", "removed", "type_changed")),
    })


def version_requests(drift: DataFrame, run_id: str | None = None, env_type: str = "dev", actor: str = "system",
                     config_col: str = "table_config_id") -> DataFrame:
    """R14 -> D34: one schema-version request per drifted config (numbered automatically,
    in config order), carrying the change record, the new column count and the run."""
    return drift.select(
        F.col(config_col).alias("table_config_id"), F.col(config_col).alias("request_seq"),
        "column_count", "column_changes_json", "change_type",
        F.lit(run_id).cast("string").alias("detected_by_run_id"), F.lit(env_type).alias("env_type"),
        F.lit(actor).alias("created_by"),
    )

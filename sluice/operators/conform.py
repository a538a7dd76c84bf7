"""Schema-side operators: D02 conformed append, D03 bootstrap, D04 additive evolution,
D05 flag normalisation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType, TimestampNTZType, TimestampType

from sluice.functions.exprs import as_flag
from sluice.schemas import TABLES


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: target column order, extra columns dropped,
    missing columns NULL, integers to booleans where the target is boolean, ISO text to
    timestamps, every column nullable."""
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for field in schema.fields:
        if field.name not in have:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        src = F.col(field.name)
        if isinstance(field.dataType, BooleanType):
            cols.append(as_flag(src, have[field.name]).alias(field.name))
        elif isinstance(field.dataType, (TimestampNTZType, TimestampType)) and have[field.name].typeName() == "string":
            # ISO-8601 text, 'T' separator accepted; a zone suffix is converted through the
            # (UTC) session zone; unparsable text becomes NULL
            zoned = src.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
            as_instant = src.try_cast(TimestampType())
            if isinstance(field.dataType, TimestampNTZType):
                val = F.when(zoned, as_instant.cast(TimestampNTZType())).otherwise(src.try_cast(TimestampNTZType()))
            else:
                val = as_instant
            cols.append(val.alias(field.name))
        else:
            cols.append(src.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def append(state: DataFrame, rows: DataFrame) -> DataFrame:
    """D02 append: conformed ``rows`` after ``state``; no rows is a no-op."""
    return state.unionByName(conform(rows, state.schema))


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def bootstrap_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Create the nine empty tables under ``root`` if absent; idempotent.

    Returns table name -> path. Existing tables are left untouched. Only the DataFrame
    reader and writer are used, so this also runs over Spark Connect.
    """
    paths = {name: f"{root.rstrip('/')}/{name}" for name in TABLES}
    for name, path in paths.items():
        if not path_exists(spark, path):
            spark.createDataFrame([], TABLES[name]).write.mode("ignore").parquet(path)
    return paths


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``: the reader looks when its plan is resolved, so no
    job runs and no file is opened. Any other failure is raised."""
    try:
        _ = spark.read.schema("x int").parquet(path).schema
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def add_column_after(df: DataFrame, name: str, dtype, after: str) -> DataFrame:
    """Add a nullable column right after ``after``; harmless when already present."""
    if name in df.columns:
        return df
    cols = []
    for c in df.columns:
        cols.append(F.col(c))
        if c == after:
            cols.append(F.lit(None).cast(dtype).alias(name))
    if after not in df.columns:
        cols.append(F.lit(None).cast(dtype).alias(name))
    return df.select(*cols)


def read_snapshots(frames: list[DataFrame]) -> DataFrame:
    """D04 for history: old snapshots without a newer column read with NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def normalise_flags(df: DataFrame, flags: list[str]) -> DataFrame:
    """The listed flag columns as booleans, whatever their stored type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: as_flag(c, types[c]) for c in flags if c in types})


def store_flags(df: DataFrame, target: StructType) -> DataFrame:
    """D05 on write: booleans back to the integer type where the target stores 0/1."""
    out = {}
    for f in target.fields:
        if f.name in df.columns and not isinstance(f.dataType, BooleanType) and isinstance(df.schema[f.name].dataType, BooleanType):
            out[f.name] = F.col(f.name).cast("int").cast(f.dataType)
    return df.withColumns(out) if out else df

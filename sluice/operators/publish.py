"""Publishing several tables at once (D31, D37): versions first, then one manifest.

Each publication writes the changed tables whole under paths of its own and only then a
manifest that names the path of every table. Readers take the tables from the newest manifest,
so they see all of a publication or nothing of it; a job that fails between two tables leaves
them on the old set, and its half-written paths are named by no manifest.

A manifest is one file, moved into place by the commit of its write. Publications to one root
come from one job at a time: two at once would both build on the same manifest, and the later
one to commit would fail on its sequence number (the folder exists) rather than overwrite.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.conform import path_exists

MANIFEST = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("table_name", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("schema_json", T.StringType()), T.StructField("n_tables", T.LongType())])


def _manifests(root: str) -> str:
    return f"{root.rstrip('/')}/_manifests"


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, tuple[str, str]]]:
    """(sequence number, table -> (path, schema as JSON)) of the newest whole manifest; 0 and
    nothing before the first publication. A few rows per publication are read."""
    if not path_exists(spark, _manifests(root)):
        return 0, {}
    rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(_manifests(root))
    whole = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.max("n_tables").alias("n_tables")).where("n = n_tables")
    last = whole.agg(F.max("seq")).first()[0]
    if last is None:
        return 0, {}
    return last, {r.table_name: (r.path, r.schema_json) for r in rows.where(F.col("seq") == last).collect()}


def read_published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest publication. All paths come from one manifest, so a
    publication in between does not mix sets."""
    _, tables = current(spark, root)
    return {name: spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(path) for name, (path, schema) in tables.items()}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Writes ``tables`` and switches readers to them in one step; tables published before and
    not given stay as they are. Returns the publication's sequence number."""
    seq, have = current(spark, root)
    seq += 1
    named = dict(have)
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}/seq={seq}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
        named[name] = (path, df.schema.json())
    rows = [(seq, name, path, schema, len(named)) for name, (path, schema) in sorted(named.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{_manifests(root)}/publication={seq}")
    return seq

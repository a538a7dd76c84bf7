"""R05 and R06 against a target that is stored by key: a bucketed table, published by version.

The target's rows lie in buckets of the natural key, so an upsert shuffles only the batch. The
new state is written bucketed again without dealing the target's rows anew: only the inserts,
which the batch bounds, are brought together by bucket. The next upsert finds it the same way.
Readers use a view, which is switched to the new version once that is whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.load import cdc_apply, latest_by_key, upsert_by_key


def save_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int, deal: bool = True) -> str:
    """Writes ``df`` as the table ``table`` (data under ``path``), bucketed and sorted by
    ``keys``. ``deal`` brings each bucket's rows into one task first, so a bucket is one file.
    Without it every task writes a file for each bucket it has rows of: right for a state whose
    rows lie in their buckets already (``new_state``)."""
    rows = df.repartition(buckets, *keys) if deal else df
    rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return table


def switch(spark: SparkSession, name: str, table: str) -> None:
    """Readers of the view ``name`` see ``table`` from now on."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {table}")


def _null_key(keys: list[str]) -> Column:
    cond = F.col(keys[0]).isNull()
    for k in keys[1:]:
        cond = cond | F.col(k).isNull()
    return cond


def _by_key(target: DataFrame, batch: DataFrame, keys: list[str], apply: Callable[[DataFrame, DataFrame, bool], DataFrame]) -> DataFrame:
    """``apply(target, batch, null_safe)`` with plain equality, which the buckets serve. Rows
    with a NULL key match null-safe and apart; they are read only if the batch has any."""
    bad = _null_key(keys)
    if batch.filter(bad).isEmpty():
        return apply(target, batch, False)
    sure = apply(target.filter(~bad), batch.filter(~bad), False)
    return sure.unionByName(apply(target.filter(bad), batch.filter(bad), True))


def upsert_bucketed(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """R05 (``upsert_by_key``) on a bucketed target: the same rows, without an exchange of the
    target. Its number of buckets should not be below ``spark.sql.shuffle.partitions``, or the
    planner may prefer to deal both sides again."""
    return _by_key(target, batch, keys, lambda t, b, safe: upsert_by_key(t, b, keys, order, null_safe=safe))


def new_state(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """The state after ``upsert_bucketed``, ready to be written with ``deal=False``: the target's
    rows stay in the tasks that read their buckets, the inserts are dealt by bucket. So a bucket
    gets one file from either side (NULL keys, in a run that has any, add their own)."""
    new = upsert_bucketed(target, batch, keys, order)
    # the action is a constant of each side, so each filter leaves one side of the union
    fresh = F.col("merge_action") == "insert"
    stay, inserts = new.filter(~fresh), new.filter(fresh).repartition(buckets, *keys)
    return stay.unionByName(inserts).drop("merge_action")


def cdc_bucketed(target: DataFrame, changes: DataFrame, keys: list[str], seq_col: str, op_col: str, value_cols: list[str]) -> DataFrame:
    """R06 (``cdc_apply``) on a bucketed target."""
    return _by_key(target, changes, keys, lambda t, c, safe: cdc_apply(t, c, keys, seq_col, op_col, value_cols, null_safe=safe))


def load_bucketed(spark: SparkSession, name: str, root: str, version: str, rows: DataFrame, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """First load: the latest row per key becomes version ``version`` of ``name``."""
    save_bucketed(latest_by_key(rows, keys, order), f"{name}_{version}", f"{root.rstrip('/')}/{name}/version={version}", keys, buckets)
    switch(spark, name, f"{name}_{version}")
    return spark.table(name)


def apply_upsert(spark: SparkSession, name: str, root: str, version: str, batch: DataFrame, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """One upsert run: the current version with ``batch`` applied becomes ``version``, then
    readers are switched. The earlier version stays for readers that still use it; a version
    that exists is an error. Returns the new state."""
    new = new_state(spark.table(name), batch, keys, order, buckets)
    table = f"{name}_{version}"
    save_bucketed(new, table, f"{root.rstrip('/')}/{name}/version={version}", keys, buckets, deal=False)
    switch(spark, name, table)
    return spark.table(name)

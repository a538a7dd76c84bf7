"""Taking rows of a table by (id, text hash)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose (id, text hash) is a row (id, h) of ``kept``.
    Of rows that repeat an id and text exactly one stays (the smallest as JSON)."""
    names = docs.columns
    verdict = kept.groupBy(F.col("id").alias("_k_id"), F.col("h").alias("_k_h")).agg(F.count(F.lit(1)).alias("_k_n"))
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("_id"), text_hash(text_col).alias("_h"))
    found = rows.join(verdict, same("_id", "_k_id") & (F.col("_h") == F.col("_k_h")))
    once = found.where("_k_n = 1").select("row")
    again = found.where("_k_n > 1").groupBy("_id", "_h").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.unionByName(again).select("row.*")

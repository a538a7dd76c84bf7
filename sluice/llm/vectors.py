"""Embedding rows as vectors of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def is_finite(vec: Column) -> Column:
    """The vector is there and so is every entry, as a finite number."""
    top = F.lit(float("inf"))
    return F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < top)), F.lit(False))


def whole(vec: Column, limit: int) -> Column:
    """floor(256 * c) of every entry c, as double, as a long; beyond +-``limit`` it is that limit."""
    big = F.lit(float(limit))
    return F.transform(vec, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, -big), big)))


def usual_length(rows: DataFrame, vec_col: str) -> int:
    """The length that most vectors have (ties: the longest); 0 without any entry."""
    sizes = rows.select(F.size(vec_col).alias("d")).where("d > 0").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return row.d if row else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls, every list ``dims`` long, as a rows x dims array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

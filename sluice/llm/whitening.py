"""Embedding whitening from an exact, bit-sliced scatter matrix.

Entries become whole numbers x. Over the fit list (each distinct vector once), every task
takes its vectors in blocks: each dimension is shifted by its least value in the block, and
the bits of one place over all rows of the block are packed into words, one plane per
(dimension, place). The cross-product of two dimensions is the sum over their planes of
2**(place + place) times the number of ones in the AND of the planes; taking the shifts back
gives the exact sum of x_i * x_j. Sums over blocks and tasks stay whole numbers, and the
matrix is centred as n * sum(x_i x_j) - S_i * S_j before anything is rounded.

Scale: one shuffle makes the vectors distinct (copies combine before it); a task hands on one
row per pair of dimensions, summed in Spark, so the driver sees a matrix whose size depends on
the number of dimensions alone. Whitening is one pass over all rows with that model broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.vectors import is_finite, matrix, usual_length, whole
from sluice.session import pin

LIMIT = 1 << 61
BLOCK = 4096
LOW_BITS = 60
#: A component with less than this share of the largest variance is rounding, not a direction.
FLAT = 1e-10


def planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the columns of ``u`` (rows x dims, not negative): words (planes x words of
    64 rows), the place of every plane, and the first plane of every dimension."""
    widths = [max(1, int(top).bit_length()) for top in u.max(axis=0)]
    place = np.concatenate([np.arange(w) for w in widths])
    dim = np.repeat(np.arange(u.shape[1]), widths)
    bits = ((u.T[dim] >> place[:, None]) & 1).astype(np.uint8)
    packed = np.packbits(bits, axis=1)
    pad = -packed.shape[1] % 8
    packed = np.pad(packed, ((0, 0), (0, pad)))
    return packed.view(np.uint64), place, np.concatenate(([0], np.cumsum(widths)[:-1]))


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact column sums and sums of products of every two columns of the whole-number matrix
    ``x`` (rows x dims), as Python numbers."""
    low = x.min(axis=0)
    words, place, first = planes(x - low)
    count = np.zeros((len(words), len(words)), dtype=np.int64)
    for p in range(len(words)):
        count[p, p:] = np.bitwise_count(words[p] & words[p:]).sum(axis=1)
    count = np.maximum(count, count.T)  # one triangle is zero
    ones = np.diag(count)
    if 2 * int(place.max()) + 2 + len(x).bit_length() + 2 * x.shape[1].bit_length() > 62:
        count, ones, place = count.astype(object), ones.astype(object), place.astype(object)
    weight = 2**place
    both = np.add.reduceat(np.add.reduceat(count * weight[:, None] * weight, first, axis=0), first, axis=1).astype(object)
    each = np.add.reduceat(ones * weight, first).astype(object)
    low, n = low.astype(object), len(x)
    sums = each + n * low
    return sums, both + np.outer(low, each) + np.outer(each, low) + n * np.outer(low, low)


def _partial(dims: int, block: int):
    """Rows (i, j, high, low) of a task's vectors: sums of products (i <= j), column sums
    (i = -1) and the number of vectors (i = j = -1), as high * 2**60 + low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, both = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for at in range(0, len(x), block):
                s, b = cross_products(x[at : at + block])
                n, sums, both = n + len(x[at : at + block]), sums + s, both + b
        if n:
            i, j = np.triu_indices(dims)
            values = [n, *sums, *both[i, j]]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(([-1], np.full(dims, -1), i)).astype(np.int32)),
                pa.array(np.concatenate(([-1], np.arange(dims), j)).astype(np.int32)),
                pa.array([Decimal(v >> LOW_BITS) for v in values], pa.decimal128(38, 0)),
                pa.array([v & ((1 << LOW_BITS) - 1) for v in values], pa.int64())], ["i", "j", "high", "low"])

    return run


class Model:
    """n, S, the components (rows), their variances and shares of the whole variance."""

    __slots__ = ("n", "sums", "components", "variances", "explained", "defined")

    def __init__(self, n: int, sums: list[int], both: dict[tuple[int, int], int], wanted: int):
        dims = len(sums)
        self.n, self.sums = n, sums
        v = np.empty((dims, dims))
        for (i, j), total in both.items():  # whole numbers until the one division
            v[i, j] = v[j, i] = (n * total - sums[i] * sums[j]) / (n * n)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[: min(wanted, dims)]
        trace = float(np.trace(v))
        self.variances, self.components = values[order], vectors[:, order].T
        self.defined = self.variances > FLAT * max(float(values.max()), 0.0)
        self.explained = [max(0.0, float(e / trace)) if trace > 0 else None for e in self.variances]

    def project(self, x: np.ndarray) -> tuple[list, np.ndarray]:
        """Deviation of every row (exact, as Python numbers or longs) and whitened rows."""
        reach = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums)) if len(x) else 0
        if reach * reach * x.shape[1] < 1 << 63:
            off = self.n * x - np.array(self.sums, dtype=np.int64)
            deviation = (off * off).sum(axis=1)
        else:
            off = self.n * x.astype(object) - np.array(self.sums, dtype=object)
            deviation = (off * off).sum(axis=1)
        z = (off / self.n).astype(float) @ self.components.T
        return deviation, z / np.sqrt(np.where(self.defined, self.variances, 1.0))


def fit(distinct: DataFrame, dims: int, components: int = 4, block: int = BLOCK) -> Model | None:
    """The model of the rows (x: array of longs, all ``dims`` long), None without rows."""
    schema = "i int, j int, high decimal(38,0), low long"
    parts = distinct.select("x").mapInArrow(_partial(dims, block), schema).groupBy("i", "j")
    total = parts.agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    # dims * (dims + 3) / 2 + 1 rows, whatever the number of vectors
    found = {(r.i, r.j): (int(r.high) << LOW_BITS) + int(r.low) for r in total.collect()}
    if not found:
        return None
    n = found.pop((-1, -1))
    sums = [found.pop((-1, d)) for d in range(dims)]
    return Model(n, sums, found, components)


def _whiten(shared, dims: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        most = 10**38
        for batch in batches:
            deviation, z = model.project(matrix(batch.column(batch.schema.get_field_index("x")), dims))
            if deviation.dtype == object:
                exact = pa.array([Decimal(v) if v < most else None for v in deviation], pa.decimal128(38, 0))
            else:
                exact = pa.array(deviation).cast(pa.decimal128(38, 0))
            rows = [[float(v) if ok else None for v, ok in zip(r, model.defined, strict=True)] for r in z] if not model.defined.all() else list(z)
            new = {"deviation": exact, "whitened": pa.array(rows, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in names], names)

    return run


def _identity_error(fit_list: DataFrame, shared, model: Model, dims: int) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list - identity)."""
    used = [k for k, ok in enumerate(model.defined) if ok]
    if not used:
        return None
    schema = T.StructType([T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    z = fit_list.select("x").mapInArrow(_whiten(shared, dims, ["whitened"]), schema)
    z = z.select(*[F.col("whitened")[k].alias(f"z{k}") for k in used])
    pairs = [(a, b) for a in used for b in used if a <= b]
    row = z.agg(*[F.covar_pop(f"z{a}", f"z{b}").alias(f"v{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"v{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row per kept row of ``vectors`` and component (1 to ``components``, by falling
    variance, at most the number of dimensions): id, component, n (vectors fitted), deviation
    (decimal(38,0): sum of (n*x - S)**2, exact; null where it has more digits), whitened,
    explained (share of the whole variance) and identity_error (one value).

    Kept are rows whose vector is there with finite entries only and as long as most of them
    are (ties: the longest; empty vectors never). x = floor(256 * c), at most 2**61 either way.
    A component that no kept vector varies along (variance below 1e-10 of the largest; all of
    them if there is one distinct vector) has whitened null and is left out of identity_error.
    Repeated rows and null ids each keep their rows; without kept rows there are none. Extra
    columns are not read."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(is_finite(F.col("v")))
    dims = usual_length(rows, "v")
    id_type = rows.schema["id"].dataType
    fields = [T.StructField("id", id_type), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    rows = rows.where(F.size("v") == dims).select("id", whole(F.col("v"), LIMIT).alias("x"))
    fit_list = pin(rows.select("x").distinct(), "fit-list") if dims else None
    model = fit(fit_list, dims, components) if dims else None
    if model is None:
        none = rows.where("false").select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        explained, error, n = [], None, 0
    else:
        shared = spark.sparkContext.broadcast(model)
        error, explained, n = _identity_error(fit_list, shared, model, dims), model.explained, model.n
        none = rows.mapInArrow(_whiten(shared, dims, [f.name for f in fields]), T.StructType(fields))
    each = none.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share = F.array(*[F.lit(e).cast("double") for e in explained]).cast("array<double>")
    return each.select(
        F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))

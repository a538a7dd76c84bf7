"""Hard-negative mining with Kronecker-packed products.

Components are whole numbers. A block of candidates is packed into one wide integer per
dimension: every candidate has a field of it, wide enough for the largest sum that can meet
there, holding its component less the block's least one, so that no field is negative. An
anchor (biased the same way) multiplies each of these integers by one component of its own;
the sum of the products holds, field by field, the biased inner product with every candidate
of the block. Taking the fields apart and the biases back gives the exact scores.

First pass: the best rows of the anchor's own label, its positives. Second pass: for each
positive the best rows of other labels that score between ``floor`` and all of its score.

Scale: anchors come in blocks of bounded size, broadcast one at a time; the other rows stay
where they are and are scored where they are read. A task hands on at most ``top`` rows per
anchor (first pass) or per anchor and positive (second), whatever the number of ties, so a
label or a vector that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.vectors import is_finite, matrix, usual_length, whole
from sluice.session import pin

CANDIDATES = 2048
ANCHORS = 4096
_NONE = np.iinfo(np.int64).min


class Packed:
    """A block of candidates as one wide integer per dimension, with room in every field for
    products with anchors of components 0 to ``top``."""

    def __init__(self, x: np.ndarray, top: int):
        self.low = int(x.min())
        u = x - self.low
        need = (int(u.max()) * top * x.shape[1]).bit_length()
        self.field = np.dtype("<u4") if need <= 32 else np.dtype("<u8")
        self.size = len(x) * self.field.itemsize
        self.sums = u.sum(axis=1)
        self.wide = [int.from_bytes(column.tobytes(), "little") for column in np.ascontiguousarray(u.T.astype(self.field))]

    def scores(self, anchor: list[int], anchor_low: int, anchor_sum: int) -> np.ndarray:
        """Inner products with one anchor, given as components less ``anchor_low``. Taking
        back the biases may wrap around, the result may not: it fits a long."""
        total = sum(map(mul, anchor, self.wide))
        fields = np.frombuffer(total.to_bytes(self.size, "little"), dtype=self.field).astype(np.int64)
        return fields + anchor_low * self.sums + (self.low * anchor_sum + len(anchor) * self.low * anchor_low)


def _better(score: np.ndarray, ids: np.ndarray, more_score: np.ndarray, more_ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` of both lists: higher scores first, ties by smaller id."""
    score, ids = np.concatenate((score, more_score)), np.concatenate((ids, more_ids))
    order = np.lexsort((ids, -score))[:top]
    return score[order], ids[order]


class Anchors:
    """A block of anchors: ids, labels, biased components; and what each looks for."""

    def __init__(self, rows: list[tuple[int, int, list[int]]]):
        self.ids, self.labels = [r[0] for r in rows], [r[1] for r in rows]
        x = np.array([r[2] for r in rows], dtype=np.int64)
        self.low = int(x.min())
        u = x - self.low
        self.top, self.sums, self.x = int(u.max()), [int(s) for s in u.sum(axis=1)], u.tolist()
        self.positives: list[list[tuple[int, int]]] = [[] for _ in rows]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, Packed]]:
    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        x = matrix(batch.column(2), dims)
        for at in range(0, len(x), CANDIDATES):
            part = slice(at, at + CANDIDATES)
            yield ids[part], labels[part], Packed(x[part], top)


def _best_same(shared, dims: int, top: int):
    """Per anchor the task's best rows of its label: (anchor, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in anchors.ids]
        for ids, labels, packed in _blocks(batches, dims, anchors.top):
            of_label = {v: np.flatnonzero(labels == v) for v in set(labels.tolist())}
            for a, label in enumerate(anchors.labels):
                mine = of_label.get(label)
                if mine is None:
                    continue
                s = packed.scores(anchors.x[a], anchors.low, anchors.sums[a])[mine]
                have = best[a]
                at = np.flatnonzero(s >= have[0][-1]) if len(have[0]) == top else np.arange(len(s))
                at = at[ids[mine[at]] != anchors.ids[a]]
                if len(at):
                    best[a] = _better(*have, s[at], ids[mine[at]], top)
        sizes = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(best)), sizes)), pa.array(np.concatenate([i for _, i in best])),
            pa.array(np.concatenate([s for s, _ in best]))], ["anchor", "id", "score"])

    return run


def _best_other(shared, dims: int, top: int, floor: tuple[int, int]):
    """Per anchor and positive the task's best rows of other labels within the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        up, down = floor
        wanted = [(a, k, p, -((-up * p) // down)) for a, found in enumerate(anchors.positives) for k, (_, p) in enumerate(found)]
        wanted = [w for w in wanted if w[3] <= w[2]]  # a negative score has no room below it
        best = {(a, k): (np.zeros(0, np.int64), np.zeros(0, np.int64)) for a, k, _, _ in wanted}
        of_anchor: dict[int, list[tuple[int, int, int]]] = {}
        for a, k, p, least in wanted:
            of_anchor.setdefault(a, []).append((k, p, least))
        for ids, labels, packed in _blocks(batches, dims, anchors.top):
            for a, looks in of_anchor.items():
                s = packed.scores(anchors.x[a], anchors.low, anchors.sums[a])
                s = np.where(labels == anchors.labels[a], _NONE, s)
                for k, p, least in looks:
                    have = best[a, k]
                    at = np.flatnonzero((s <= p) & (s >= (max(least, have[0][-1]) if len(have[0]) == top else least)))
                    if len(at):
                        best[a, k] = _better(*have, s[at], ids[at], top)
        rows = [(anchors.ids[a], k + 1, *anchors.positives[a][k], int(i), int(s), a) for (a, k), (ss, ii) in best.items() for s, i in zip(ss, ii, strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score", "anchor"])

    return run


def _ranked(df: DataFrame, group: list[str], score: str, id_col: str, top: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), id_col)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(vectors: DataFrame, is_anchor, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 5, floor: tuple[int, int] = (4, 5), anchor_block: int = ANCHORS) -> DataFrame:
    """For each anchor and positive the hard negatives: anchor_id, positive_id, positive_rank,
    rank (both from 1), negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the id column. An anchor's positives are its first
    ``positives`` rows of the same label with another id; a positive's negatives the first
    ``negatives`` rows of other labels with up * positive_score <= down * score <=
    down * positive_score for ``floor`` = (up, down). Higher scores come first, ties by smaller
    id; all are taken if there are fewer.

    Rows with a null id or label, a null vector or an entry that is null or not finite take no
    part, nor do vectors of another length than most have (ties: the longest). Components are
    floor(256 * x), held within a bound (2**27 either way at 64 dimensions) that lets every
    score fit a long. Anchors alike in id, label and vector are one; other repeated rows count
    each. Extra columns are not read."""
    spark = vectors.sparkSession
    cols = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")]
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(*cols, is_anchor.alias("is_anchor"))
    rows = rows.where(is_finite(F.col("v")))
    dims = usual_length(rows, "v")
    limit = 1 << ((62 - dims.bit_length()) // 2)
    rows = rows.where((F.size("v") == dims) & (F.size("v") > 0)).select("id", "label", whole(F.col("v"), limit - 1).alias("x"), "is_anchor")
    chosen = pin(rows.where("is_anchor").select("id", "label", "x").distinct(), "anchors")
    blocks = max(1, -(-chosen.count() // anchor_block))
    others = rows.select("id", "label", "x")
    found = []
    for b in range(blocks):
        block = chosen.where(F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks)) == b)
        # about ``anchor_block`` rows
        held = sorted((r.id, r.label, list(r.x)) for r in block.collect())
        if not held:
            continue
        anchors = Anchors(held)
        shared = spark.sparkContext.broadcast(anchors)
        same = others.mapInArrow(_best_same(shared, dims, positives), "anchor long, id long, score long")
        # at most ``positives`` rows per anchor of the block
        for r in sorted(_ranked(same, ["anchor"], "score", "id", positives).collect(), key=lambda r: (r.anchor, r["rank"])):
            anchors.positives[r.anchor].append((r.id, r.score))
        shared = spark.sparkContext.broadcast(anchors)
        schema = "anchor_id long, positive_rank long, positive_id long, positive_score long, negative_id long, negative_score long, anchor long"
        other = others.mapInArrow(_best_other(shared, dims, negatives, floor), schema)
        best = _ranked(other, ["anchor", "positive_rank"], "negative_score", "negative_id", negatives)
        found.append(pin(best, "negatives") if blocks > 1 else best)
    names = ["anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score"]
    if not found:
        return spark.createDataFrame([], ", ".join(f"{c} {'int' if c.endswith('rank') else 'long'}" for c in names))
    out = reduce(DataFrame.unionByName, found).withColumns({c: F.col(c).cast("int") for c in ("positive_rank", "rank")})
    return out.select(*names)

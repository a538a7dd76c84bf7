"""Toxicity: a counterfactually regularised linear classifier.

Features are byte n-grams of the lower-cased text with every non-word byte a blank, hashed
into 2**BITS buckets; a document has a feature or not, however often. The model is logistic
regression over the ``keep`` buckets that separate the classes most. For every labelled
sentence that holds identity terms a counterfactual is made by swapping them for others of
the same list, and the squared change of the logit between the two is part of the loss, so
that the mention of a group does not move a score by itself.

Fitting uses a bounded sample of labelled rows (``bound``, documented): its class counts per
bucket are summed in Spark, and the sample's selected features (``bound`` short lists) are
fitted on the driver. Scoring is one pass over all documents with the weight table
broadcast (2**BITS floats, whatever the corpus).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.labelled import held_out, labelled_texts
from sluice.llm.text import ALNUM, LOWER, mix64, slices

BITS = 20
GRAMS = (4, 6)
BOUND = 16_000
KEEP = 4_000
CLEAN = 20

# Identity terms that are swapped for one another, in English, German, French and
# Spanish. A word stands in one group only.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "trans people"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "queer", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("gais", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)

BLANK = np.where(ALNUM, np.arange(256), 32).astype(np.uint8)


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every n-gram position; a blank stands before and after each text."""
    data = BLANK[LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)]]
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    first = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    docs, found = [], []
    for n in GRAMS:
        per = np.maximum(size + 2 - n + 1, 0)
        top = len(data) - n + 1
        if top <= 0 or not per.sum():
            continue
        key = np.full(top, n << 56, dtype=np.uint64)
        for j in range(n):
            key |= data[j : j + top].astype(np.uint64) << np.uint64(8 * j)
        inside = np.zeros(top + 1, dtype=np.int8)
        np.add.at(inside, first[per > 0], 1)
        np.add.at(inside, (first + per)[per > 0], -1)
        at = np.flatnonzero(np.cumsum(inside)[:top] > 0)
        docs.append(np.repeat(np.arange(len(texts)), per))
        found.append((mix64(key[at]) >> np.uint64(64 - BITS)).astype(np.int64))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(found)


def distinct(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((doc << BITS) | bucket)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def swapper(groups=IDENTITY_TERMS):
    """A function that swaps every identity term of a text, A-Z lower-cased, for the next one of
    its group, or returns None for a text without any. A term repeated in ``groups`` is an error."""
    next_of = {t.encode(): g[(i + 1) % len(g)].encode() for g in groups for i, t in enumerate(g)}
    if len(next_of) < sum(map(len, groups)):
        raise ValueError("an identity term stands in two places")
    terms = sorted(next_of, key=len, reverse=True)
    if not terms:
        return lambda text: None
    find = re.compile(rb"(?<![0-9a-z\x80-\xff])(" + b"|".join(map(re.escape, terms)) + rb")(?![0-9a-z\x80-\xff])")

    def swap(text: bytes) -> bytes | None:
        low = text.lower()
        return find.sub(lambda m: next_of[m[1]], low) if find.search(low) else None

    return swap


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        y = np.asarray(batch.column(1).to_pylist(), dtype=np.int64)
        for row, texts in slices(batch, "text"):
            doc, bucket = distinct(*buckets(texts))
            for label in (0, 1):
                total[label] += np.bincount(bucket[y[row + doc] == label], minlength=1 << BITS)
    at = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "neg", "pos"])


def _selected(slot, groups):
    """Per sampled text: label, its selected features, and those of its counterfactual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, swap = slot.value, swapper(groups)

        def lists(texts: list[bytes]) -> list[list[int]]:
            doc, bucket = distinct(*buckets(texts))
            where = index[bucket]
            doc, where = doc[where >= 0], where[where >= 0]
            return [x.tolist() for x in np.split(where, np.searchsorted(doc, np.arange(1, len(texts))))]

        for batch in batches:
            for row, texts in slices(batch, "text"):
                other = [swap(t) for t in texts]
                some = [i for i, o in enumerate(other) if o is not None]
                swapped = dict(zip(some, lists([other[i] for i in some]), strict=True)) if some else {}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(row, len(texts)), pa.array(lists(texts), pa.list_(pa.int64())), pa.array([swapped.get(i) for i in range(len(texts))], pa.list_(pa.int64()))],
                    ["y", "x", "twin"])

    return run


class Sparse:
    """Rows of feature lists as a 0/1 matrix with products from both sides."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter((c for r in rows for c in r), dtype=np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], minlength=self.width)


def fit(rows: list[list[int]], y: np.ndarray, twins: list[list[int] | None], width: int, fairness: float = 4.0, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias minimising mean log loss + ridge + fairness * mean squared logit
    change over the rows that have a counterfactual (Adam, full batch, fixed steps). The
    rarer class weighs more, by the square root of the classes' ratio. ``CLEAN`` clean texts
    without any feature count among the rows, so a text that shows none is clean unless the
    sample outweighs them."""
    paired = [i for i, t in enumerate(twins) if t is not None]
    x = Sparse(rows, width)
    a, b = Sparse([rows[i] for i in paired], width), Sparse([twins[i] for i in paired], width)
    ratio = np.sqrt((len(y) - y.sum() + 1) / (y.sum() + 1))
    weight = np.where(y > 0, ratio, 1.0)
    clean = CLEAN / (weight.sum() + CLEAN)
    weight /= weight.sum() + CLEAN
    w, bias = np.zeros(width), float(-np.log(ratio))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -40, 40)))
        err = (p - y) * weight
        grad = x.back(err) + ridge * w
        if paired:
            change = a.dot(w) - b.dot(w)
            grad += 2 * fairness * (a.back(change) - b.back(change)) / len(paired)
        g = np.append(grad, err.sum() + clean / (1 + np.exp(-np.clip(bias, -40, 40))))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


class Model:
    """Weight per bucket and bias."""

    __slots__ = ("table", "bias")

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, bucket = buckets(texts)
        hit = np.flatnonzero(self.table[bucket])
        doc, bucket = distinct(doc[hit], bucket[hit])
        logit = np.bincount(doc, self.table[bucket], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND, keep: int = KEEP, groups=IDENTITY_TERMS, fairness: float = 4.0) -> Model:
    """Fits on about ``bound`` labelled rows outside the held-out part. Without labelled rows of
    both classes no text is told from another: every score is half the toxic share (one row of
    each class added), so below 0.5."""
    spark = docs.sparkSession
    sample = labelled_texts(docs, labels, label_col, bound, id_col, text_col)
    counts = sample.mapInArrow(_class_counts, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    share = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    n, pos = share.n, share.pos or 0
    if not n or not pos or pos == n:
        share = (pos + 1) / (n + 2) / 2
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    # standardised log odds ratio of having the bucket, by class
    smooth = lambda c, total: (F.col(c) + 0.5) / (F.lit(float(total)) - F.col(c) + 0.5)
    spread = 1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)
    z = F.abs(F.log(smooth("pos", pos) / smooth("neg", n - pos))) / F.sqrt(spread)
    chosen = [r.bucket for r in counts.where("pos + neg >= 3").orderBy(z.desc(), "bucket").limit(keep).select("bucket").collect()]
    slot = np.full(1 << BITS, -1, dtype=np.int64)
    slot[chosen] = np.arange(len(chosen))
    shared = spark.sparkContext.broadcast(slot)
    schema = "y int, x array<bigint>, twin array<bigint>"
    # the selected features of the bounded sample
    rows = [(r.y, list(r.x), None if r.twin is None else list(r.twin)) for r in sample.mapInArrow(_selected(shared, groups), schema).toLocalIterator()]
    rows.sort(key=lambda r: (r[0], r[1], r[2] or []))  # the same order in every run
    w, bias = fit([r[1] for r in rows], np.array([r[0] for r in rows], dtype=float), [r[2] for r in rows], len(chosen), fairness)
    table = np.zeros(1 << BITS)
    table[chosen] = w
    return Model(table, bias)


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, texts in slices(batch, "text"):
                part = batch.slice(row, len(texts))
                new = {"score": pa.array(model.score(texts))}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(part.schema.get_field_index(c)) for c in names], names)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1), predicted (score >= 0.5).
    Null and empty texts get the score of a text without features; repeated rows the same
    score each; only the text enters a score. Extra columns are not read."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", d.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = d.mapInArrow(_score(shared, schema.names), schema)
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5. Null and empty texts show no
    feature and stay. Without labelled rows of both classes all rows stay, and with few of them
    every text that shows none of the learnt features; repeated rows share a verdict."""
    rest = [c for c in docs.columns if c != text_col]
    d = docs.select(F.struct(*rest).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", d.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = d.mapInArrow(_score(shared, schema.names), schema).where("score < 0.5")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("id")[c].alias(c) for c in docs.columns])

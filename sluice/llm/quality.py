"""Quality: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled of good quality; the other side is unlabelled web
text, drawn from all documents whatever their label. No label 0 is used. The share of good
documents in the unlabelled text (the class prior) is estimated from the scores of a first
positive-against-unlabelled classifier: over score cuts c, the share of unlabelled text
above c divided by the share of held-back positives above c is smallest where only good
documents are left (both shares with their confidence margins). The classifier then
minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the sigmoid loss, starting
from the first one.

Features are shares and ratios of a text's bytes, words and lines, cut into quantile bins.
Fitting uses bounded samples (``bound`` rows of each side, documented) on the driver;
scoring is one pass over all documents with cuts and weights broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.labelled import drawn_texts, held_out, labelled_texts
from sluice.llm.text import BYTE_CODE, INVERSE, NONSPACE, ODD, Buffer, Words, mix64, power_table, run_hash, slices

BOUND = 12_000
BINS = 12
THRESHOLD = 0.3


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars.encode(), dtype=np.uint8)] = True
    return out


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _bytes("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_KINDS = (_bytes("0123456789"), _bytes("#$%&*@^~<>{}[]\\/=+_"), _bytes("!?"), _bytes("|"), _bytes("\n"), _bytes(".,;:"), ~NONSPACE)

FEATURES = (
    "log_bytes", "upper", "digits", "symbols", "bangs", "bars", "newlines", "stops", "spaces", "word_length", "word_spread",
    "distinct_words", "distinct_pairs", "echoed", "commonest", "distinct_lines", "initial_upper", "marked_words",
)


def _distinct_share(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(share of distinct hashes, share of the commonest hash) per document; 1 and 0 without any."""
    total = np.bincount(doc, minlength=n)
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(d)))
    top = np.zeros(n)
    np.maximum.at(top, d[first], length)
    safe = np.maximum(total, 1)
    return np.where(total, np.bincount(d[first], minlength=n) / safe, 1.0), top / safe


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text gives finite values."""
    n = len(texts)
    buf = Buffer(texts, b"\n")
    data = buf.data
    size = buf.ends - buf.starts
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.append(buf.starts, len(data))])
    own = lambda table: sums(table[data]) - table[10]  # without the separator
    safe = np.maximum(size, 1)
    letters = np.maximum(own(_LETTER), 1)
    w = Words(buf, NONSPACE, lower=False)
    count = np.maximum(w.counts(), 1)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, length, minlength=n) / count
    spread = np.sqrt(np.maximum(np.bincount(w.doc, length**2, minlength=n) / count - mean**2, 0))
    words, commonest = _distinct_share(w.doc, w.hash, n)
    pair_ok = w.doc[1:] == w.doc[:-1]
    pairs, _ = _distinct_share(w.doc[:-1][pair_ok], run_hash(w.hash, 2)[pair_ok], n) if len(w.doc) > 1 else (np.ones(n), None)
    echo = np.bincount(w.doc[1:][(w.hash[1:] == w.hash[:-1]) & pair_ok], minlength=n) / count if len(w.doc) > 1 else np.zeros(n)
    # lines: hash of the bytes between newlines (the separator ends the last one)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    line_doc = np.searchsorted(buf.ends, ends)
    line_hash = mix64((ends - starts).astype(np.uint64)) + _line_codes(data, starts, ends)
    lines, _ = _distinct_share(line_doc, line_hash, n)
    initial = np.bincount(w.doc, _UPPER[data[w.start]], minlength=n) / count
    marks = np.concatenate(([0], np.cumsum(_KINDS[1][data] | _KINDS[2][data] | _KINDS[3][data])))
    marked = np.bincount(w.doc, marks[w.end] > marks[w.start], minlength=n) / count
    cols = [np.log1p(size), own(_UPPER) / letters, *[own(k) / safe for k in _KINDS], mean, spread, words, pairs, echo, commonest, lines, initial, marked]
    return np.column_stack(cols)


def _line_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit code of data[start:end] for every line."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * power_table(ODD, n)[:n], out=total[1:])
    return (total[ends] - total[starts]) * power_table(INVERSE, n + 1)[starts]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(list(features(texts)), pa.list_(pa.float64()))], ["x"])


class Bins:
    """Quantile bins of every feature as 0/1 columns."""

    __slots__ = ("cuts", "offset", "width")

    def __init__(self, x: np.ndarray, bins: int = BINS):
        q = np.linspace(0, 1, bins + 1)[1:-1]
        # the extreme tails get bins of their own: rare styles sit there
        q = np.unique(np.concatenate((q, [0.002, 0.01, 0.03, 0.97, 0.99, 0.998])))
        self.cuts = [np.unique(np.quantile(c, q)) for c in x.T]
        self.offset = np.concatenate(([0], np.cumsum([len(c) + 1 for c in self.cuts])))
        self.width = int(self.offset[-1])

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([o + np.searchsorted(c, v, side="right") for c, o, v in zip(self.cuts, self.offset, x.T, strict=False)])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pu(pos: np.ndarray, unl: np.ndarray, width: int, prior: float | None, start: tuple[np.ndarray, float] | None = None, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias over 0/1 columns. Without a prior: positives against unlabelled with
    the logistic loss. With one: the non-negative PU risk with the sigmoid loss, whose bounded
    values keep the difference R_u(-) - prior * R_p(-) from drowning in far-off positives."""
    w, bias = (np.zeros(width), 0.0) if start is None else (start[0].copy(), start[1])
    m, v = np.zeros(width + 1), np.zeros(width + 1)

    def gradient(rows, g):
        return np.append(np.bincount(rows.ravel(), np.repeat(g, rows.shape[1]), minlength=width), g.sum())

    for step in range(1, steps + 1):
        sp, su = _sigmoid(w[pos].sum(axis=1) + bias), _sigmoid(w[unl].sum(axis=1) + bias)
        if prior is None:
            g = gradient(pos, (sp - 1) / len(pos)) + gradient(unl, su / len(unl))
        else:
            slope_p = gradient(pos, sp * (1 - sp) / len(pos))
            neg = gradient(unl, su * (1 - su) / len(unl)) - prior * slope_p
            # below zero the estimate has over-fitted: step back on that part alone
            g = neg - prior * slope_p if su.mean() >= prior * sp.mean() else -neg
        g[:-1] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


def estimate_prior(score_pos: np.ndarray, score_unl: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores not used in the fit; the estimate
    is drawn towards one half by the width of its margin, which falls with the sample."""
    cuts = np.unique(np.concatenate((score_pos, score_unl)))
    sp, su = np.sort(score_pos), np.sort(score_unl)
    above_p = 1 - np.searchsorted(sp, cuts, side="left") / len(sp)
    above_u = 1 - np.searchsorted(su, cuts, side="left") / len(su)
    margin = np.sqrt(np.log(4 / delta) / 2 / len(sp)) + np.sqrt(np.log(4 / delta) / 2 / len(su))
    best = np.argmin((above_u + margin) / np.maximum(above_p, 1e-9))
    found = min(1.0, above_u[best] / max(above_p[best], 1e-9))
    return float(np.clip((found + 0.5 * margin) / (1 + margin), 0.01, 0.99))


class Model:
    __slots__ = ("bins", "w", "bias", "prior")

    def __init__(self, bins, w, bias, prior):
        self.bins, self.w, self.bias, self.prior = bins, w, bias, prior

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.bins is None:  # no positive is known
            return np.full(len(texts), self.prior)
        return _sigmoid(self.w[self.bins.columns(features(texts))].sum(axis=1) + self.bias)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND) -> Model:
    """Fits on about ``bound`` trusted positives and ``bound`` unlabelled documents, none of
    them held out, from one positive on. Without a positive every score is the share that one
    among the unlabelled would have; without unlabelled texts the positives stand in for them."""
    collect = lambda df: np.array(sorted(list(r.x) for r in df.select("text").mapInArrow(_feature_rows, "x array<double>").toLocalIterator()))
    pos = collect(labelled_texts(docs, labels, label_col, bound, id_col, text_col, only=1))
    unl = collect(drawn_texts(docs, bound, id_col, text_col))
    if not len(pos):
        return Model(None, None, 0.0, 1 / (len(unl) + 2))
    unl = unl if len(unl) else pos
    bins = Bins(np.concatenate((unl, pos)))
    p, u = bins.columns(pos), bins.columns(unl)
    w, bias = fit_pu(p[::2], u[::2], bins.width, None)
    value = lambda rows: w[rows].sum(axis=1) + bias
    # a single row is on both sides of the split
    prior = estimate_prior(value(p[1::2] if len(p) > 1 else p), value(u[1::2] if len(u) > 1 else u))
    w, bias = fit_pu(p, u, bins.width, prior, start=(w, bias))
    return Model(bins, w, bias, prior)


def _score(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, texts in slices(batch, "text"):
                part = batch.slice(row, len(texts))
                new = {"score": pa.array(model.score(texts))}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(part.schema.get_field_index(c)) for c in names], names)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1), predicted (score >=
    ``threshold``). Null and empty texts get the score of a text without bytes; repeated rows
    the same score each; only the text enters a score. Extra columns are not read."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", d.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = d.mapInArrow(_score(shared, schema.names), schema)
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

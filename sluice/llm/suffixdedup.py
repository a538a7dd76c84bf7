"""Suffix-array dedup: bytes of every string of ``length`` bytes that starts more than once.

Merging Burrows-Wheeler transforms over raw bytes takes one pass over all suffixes per byte
of common prefix. Two exact reductions come first:

* Every window of ``length`` bytes has an anchor, its least hashed k-gram. Equal windows have
  the same anchor at the same place, so only windows whose anchor's k-gram is found at
  several anchors can repeat. Consecutive windows with one anchor are a *piece*; equal
  pieces are counted once, and pieces found more than once are repeated whole.
* Symbols are blocks of ``length / ROUNDS`` bytes: a suffix is read in steps of a block, so a
  common prefix of ``length`` bytes is ROUNDS symbols.

The distinct pieces of an anchor k-gram meet in one bucket. In a bucket, every shard of
pieces gets its suffix order and BWT on its own; shards are then merged by refining the
interleave bits: round r places each entry, read in the interleave of round r - 1, behind its
BWT symbol, which orders all suffixes by r symbols without comparing or re-sorting suffixes.
A block border that appears in round r is a common prefix of r - 1 symbols; intervals that
have no border after ROUNDS rounds are repeated windows.

Scale: buckets hold about ``bucket_bytes``; an anchor k-gram with more than ``group`` distinct
pieces (a passage in very many documents) is left out of the buckets, and its windows are
counted in a Spark aggregation by their ROUNDS block symbols, so no task holds such a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.rows import same, text_hash
from sluice.llm.text import BYTE_CODE, INVERSE, ODD, mix64, power_table, ranges, text_bytes
from sluice.session import pin

GRAM = 32
ROUNDS = 5
BUCKET_BYTES = 2 << 20
SHARD_BYTES = 1 << 20
GROUP = BUCKET_BYTES // 512  # about as many pieces as fill a bucket
_STRETCH = 1 << 20  # longest run of bytes whose anchors are found at once


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * power_table(ODD, len(data))[: len(data)], out=total[1:])
    return total


def _hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], wherever it stands."""
    return mix64((total[end] - total[start]) * power_table(INVERSE, len(total))[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor position, anchor hash) of every window; the leftmost least k-gram."""
    total = _prefix(data)
    at = np.arange(len(data) - gram + 1)
    h = _hash(total, at, at + gram)
    low = np.uint64(24)
    value = (h >> low << low) | at.astype(np.uint64)
    width = length - gram + 1
    pad = np.full(-len(value) % width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid = np.concatenate((value, pad)).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    return place, h[place]


def pieces(text: bytes, length: int, gram: int = GRAM) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Columns fp (anchor hash), ph (piece hash), start and windows of a text's pieces. Long
    texts are taken in stretches that share their windows' bytes."""
    out = []
    for first in range(0, max(0, len(text) - length + 1), _STRETCH):
        data = np.frombuffer(text, dtype=np.uint8)[first : first + _STRETCH + length - 1]
        place, fp = anchors(data, length, gram)
        new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        windows = np.diff(np.append(new, len(place)))
        ph = _hash(_prefix(data), new, new + windows + length - 1)
        out.append((fp[new], ph, new + first, windows))
    return out


def _piece_rows(id_type, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "h", "fp", "ph", "start", "windows"]
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
            rows, cols, held = [], [], 0
            for i, t in enumerate(texts):
                for part in pieces(t, length):
                    rows.append(np.full(len(part[0]), i)), cols.append(part)
                    held += len(part[0])
                if cols and (held > 50_000 or i == len(texts) - 1):
                    at = pa.array(np.concatenate(rows))
                    fp, ph, start, windows = (np.concatenate(c) for c in zip(*cols, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(batch.schema.get_field_index("id")).take(at), batch.column(batch.schema.get_field_index("h")).take(at),
                         pa.array(fp.view(np.int64)), pa.array(ph.view(np.int64)), pa.array(start), pa.array(windows)], names)
                    rows, cols, held = [], [], 0
            if cols:
                at = pa.array(np.concatenate(rows))
                fp, ph, start, windows = (np.concatenate(c) for c in zip(*cols, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("id")).take(at), batch.column(batch.schema.get_field_index("h")).take(at),
                     pa.array(fp.view(np.int64)), pa.array(ph.view(np.int64)), pa.array(start), pa.array(windows)], names)

    return run


def _cut(length: int):
    """Rows (text, wanted: list of piece references) to rows with the pieces' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "ph", "weight", "hot", "bytes"]
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
            out, held = [], 0
            for text, wanted in zip(texts, batch.column(batch.schema.get_field_index("wanted")).to_pylist(), strict=True):
                for w in wanted:
                    piece = text[w["start"] : w["start"] + w["windows"] + length - 1]
                    out.append((w["fp"], w["ph"], w["weight"], w["hot"], piece))
                    held += len(piece)
                if held > 1 << 21:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    return run


class Collection:
    """The suffixes of a bucket's pieces in steps of ``step`` bytes, as far as they can matter.

    A block found once in the bucket cannot lie in a repeated window, so only windows of
    ``rounds`` blocks that each occur again are candidates; the suffixes kept are the
    candidates and what follows them step by step. ``sym`` is a suffix's first block (0 where
    its chain ends), ``next`` the suffix a block further on, ``bwt`` the block before it."""

    def __init__(self, texts: list[bytes], step: int, rounds: int):
        size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        base = np.concatenate(([0], np.cumsum(size + 1)))
        n = int(base[-1])
        piece = np.repeat(np.arange(len(texts), dtype=np.int32), size + 1)
        left = (np.repeat(base[1:] - 1, size + 1) - np.arange(n)).astype(np.int32)
        data = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
        has = np.flatnonzero(left >= step)
        sym = np.zeros(n, dtype=np.int32)
        if len(has):
            _, rank, often = np.unique(_hash(_prefix(data), has, has + step), return_inverse=True, return_counts=True)
            rank = rank.ravel()
            sym[has] = np.where(often[rank] > 1, rank + 1, 0)
        full = left >= step * rounds
        for k in range(rounds):
            full[: n - k * step] &= sym[k * step :] > 0
        need = full.copy()
        for k in range(1, rounds + 1):
            need[k * step :] |= full[: n - k * step]
        at = np.flatnonzero(need)
        index = np.full(n + step, -1, dtype=np.int64)
        index[at] = np.arange(len(at))
        follows = np.where(left[at] >= step, index[at + step], -1)
        follows[sym[at] == 0] = -1
        self.piece, self.x, self.full = piece[at], at - base[piece[at]], full[at]
        self.next, self.sym = follows, np.where(follows >= 0, sym[at], 0).astype(np.int32)
        self.bwt = np.zeros(len(at), dtype=np.int32)
        ok = follows >= 0
        self.bwt[follows[ok]] = self.sym[ok]

    def order(self, at: np.ndarray, rounds: int) -> np.ndarray:
        """Suffixes ``at`` sorted by their first ``rounds`` symbols, those without any first."""
        keys, here = [], at
        for _ in range(rounds):
            keys.append(np.where(here >= 0, self.sym[here], 0))
            here = np.where(here >= 0, self.next[here], -1)
        out = np.arange(len(at))
        for key in reversed(keys):
            out = out[stable_order(key[out])]
        return at[out]


def stable_order(c: np.ndarray) -> np.ndarray:
    """Stable argsort of symbols by two 16-bit radix passes (more where symbols are larger)."""
    order, top, shift = np.argsort((c & 0xFFFF).astype(np.uint16), kind="stable"), int(c.max(initial=0)), 16
    while top >> shift:
        order = order[np.argsort(((c[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def merge(bwt_a: np.ndarray, bwt_b: np.ndarray, empty_a: int, empty_b: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, interval) of two shards' sorted suffixes from their transforms alone.

    ``interleave`` is True where the next suffix of shard b stands. ``interval`` numbers the
    runs of suffixes that share ``rounds`` symbols. ``empty_*``: how many empty suffixes a
    shard's order starts with; they stay first and apart from all others."""
    n = len(bwt_a) + len(bwt_b)
    z = np.zeros(n, dtype=bool)
    z[len(bwt_a) :] = True
    interval = np.zeros(n, dtype=np.int64)
    head = np.concatenate((np.zeros(empty_a, dtype=bool), np.ones(empty_b, dtype=bool)))
    for _ in range(rounds):
        c = np.empty(n, dtype=np.int32)
        c[~z], c[z] = bwt_a, bwt_b
        has = np.flatnonzero(c)
        go = has[stable_order(c[has])]
        sym, old = c[go], interval[go]
        border = np.ones(len(go), dtype=np.int64)
        border[1:] = (sym[1:] != sym[:-1]) | (old[1:] != old[:-1])
        z = np.concatenate((head, z[go]))
        interval = np.concatenate((np.zeros(len(head), dtype=np.int64), np.cumsum(border)))
    return z, interval


def repeated_windows(texts: list[bytes], weight: np.ndarray, length: int, rounds: int = ROUNDS, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window start) of the windows of ``length`` bytes found at least twice, weights
    counting how often a piece occurs. Shards are ordered alone and merged one by one."""
    c = Collection(texts, length // rounds, rounds)
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    shard = (np.cumsum(size) // shard_bytes)[c.piece]
    empty = lambda o: int((c.sym[o] == 0).sum())
    parts = [c.order(np.flatnonzero(shard == k), rounds) for k in np.unique(shard)]
    order = parts[0] if parts else np.zeros(0, dtype=np.int64)
    interval = np.zeros(0, dtype=np.int64)
    for own in parts[1:] or [order[:0]]:
        z, interval = merge(c.bwt[order], c.bwt[own], empty(order), empty(own), rounds)
        merged = np.empty(len(z), dtype=np.int64)
        merged[~z], merged[z] = order, own
        order = merged
    keep = c.full[order]
    order, interval = order[keep], interval[keep]
    if not len(order):
        return order, order
    often = np.bincount(interval, weight[c.piece[order]])
    found = np.sort(order[often[interval] >= 2])
    return c.piece[found].astype(np.int64), c.x[found]


def _runs(piece: np.ndarray, x: np.ndarray):
    """Runs of consecutive windows of one piece: (piece, first, end)."""
    if not len(piece):
        return piece, x, x
    new = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (x[1:] != x[:-1] + 1))))
    end = np.append(new[1:], len(piece)) - 1
    return piece[new], x[new], x[end] + 1


def _bucket(length: int, rounds: int, shard_bytes: int):
    def run(table: pa.Table) -> pa.Table:
        fp, ph = table.column("fp").to_numpy(), table.column("ph").to_numpy()
        texts = table.column("bytes").to_pylist()
        weight = table.column("weight").to_numpy().astype(float)
        by = np.lexsort((ph, fp))  # the same order in every run
        piece, x = repeated_windows([texts[i] for i in by], weight[by], length, rounds, shard_bytes)
        piece, a, b = _runs(piece, x)
        return pa.table({"fp": fp[by][piece], "ph": ph[by][piece], "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _symbols(length: int, rounds: int):
    """Windows of hot pieces with a 128-bit code of their block symbols."""
    step = length // rounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, ph, weight = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("fp", "ph", "weight"))
            texts = batch.column(batch.schema.get_field_index("bytes")).to_pylist()
            for i, t in enumerate(texts):
                data = np.frombuffer(t, dtype=np.uint8)
                x = np.arange(len(data) - length + 1)
                total, one, two = _prefix(data), np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
                for r in range(rounds):
                    s = _hash(total, x + r * step, x + (r + 1) * step)
                    one, two = mix64(one * np.uint64(ODD) + s), mix64(two ^ s) * np.uint64(ODD)
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, fp[i])), pa.array(np.full(n, ph[i])), pa.array(np.full(n, weight[i])), pa.array(x), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["fp", "ph", "weight", "x", "s1", "s2"])

    return run


def _strip(names: list[str], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
            removed, runs, shas, kept_texts = [], [], [], []
            for text, spans in zip(texts, batch.column(batch.schema.get_field_index("spans")).to_pylist(), strict=True):
                kept, upto, gone, n = [], 0, 0, 0
                for s in sorted((s["a"], s["b"]) for s in spans or []):
                    if s[0] > upto or n == 0:
                        kept.append(text[upto : s[0]])
                        n += 1
                        gone += s[1] - s[0]
                        upto = s[1]
                    elif s[1] > upto:
                        gone += s[1] - upto
                        upto = s[1]
                kept.append(text[upto:])
                rest = b"".join(kept)
                removed.append(gone), runs.append(n), shas.append(hashlib.sha256(rest).hexdigest()), kept_texts.append(rest)
            new = {
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()),
                "kept_sha256": pa.array(shas, pa.string()), "kept": pa.array(kept_texts, pa.binary())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in names], names)

    return run


def repeats(d: DataFrame, length: int, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, h, spans: byte ranges to remove) of the rows (id, h, text) that have any."""
    id_type = d.schema["id"].dataType
    long = lambda *cs: [T.StructField(c, T.LongType()) for c in cs]
    schema = T.StructType([T.StructField("id", id_type), *long("h", "fp", "ph", "start", "windows")])
    found = pin(d.mapInArrow(_piece_rows(id_type, length), schema), "pieces")
    carrier = F.min(F.struct("id", "h", "start", "windows")).alias("at")
    distinct = pin(found.groupBy("fp", "ph").agg(F.count(F.lit(1)).alias("weight"), carrier), "distinct-pieces")
    per = pin(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared-anchors")
    open_ = distinct.join(per, "fp").withColumn("hot", F.col("k") > group)
    refs = open_.select("at.id", "at.h", F.struct("fp", "ph", "weight", "hot", "at.start", "at.windows").alias("w"))
    refs = refs.groupBy("id", "h").agg(F.collect_list("w").alias("wanted")).withColumnsRenamed({"id": "_id", "h": "_h"})
    # one row of every id and text carries its pieces
    texts = d.join(refs, same("id", "_id") & (F.col("h") == F.col("_h")))
    cut = T.StructType([*long("fp", "ph", "weight"), T.StructField("hot", T.BooleanType()), T.StructField("bytes", T.BinaryType())])
    parts = pin(texts.select("text", "wanted").mapInArrow(_cut(length), cut), "piece-bytes")
    total = parts.where("NOT hot").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    cold = parts.where("NOT hot").dropDuplicates(["fp", "ph"]).withColumn("bucket", F.pmod(F.xxhash64("fp"), F.lit(buckets)))
    flagged = cold.select("bucket", "fp", "ph", "weight", "bytes").groupBy("bucket").applyInArrow(_bucket(length, rounds, shard_bytes), "fp long, ph long, a long, b long")
    hot = parts.where("hot").mapInArrow(_symbols(length, rounds), "fp long, ph long, weight long, x long, s1 long, s2 long").distinct()
    often = hot.groupBy("fp", "s1", "s2").agg(F.sum("weight").alias("n")).where("n > 1").select("fp", "s1", "s2")
    hot = hot.join(often, ["fp", "s1", "s2"]).select("fp", "ph", F.col("x").alias("a"), (F.col("x") + 1).alias("b"))
    whole = distinct.where("weight > 1").select("fp", "ph", F.lit(0).cast("long").alias("a"), F.col("at.windows").alias("b"))
    marks = flagged.unionByName(hot).unionByName(whole).groupBy("fp", "ph").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    marks = pin(marks, "repeated")
    spans = found.join(marks, ["fp", "ph"]).select("id", "h", "start", F.explode("runs").alias("r"))
    spans = spans.select("id", "h", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + length - 1).alias("b"))
    return pin(spans.groupBy("id", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_bytes: bool = True, **kw) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, with ``keep_bytes``, kept (the remaining bytes; a cut may fall inside a
    character).

    A byte goes when a string of ``length`` UTF-8 bytes that covers it also starts anywhere
    else, in the same document or another; matches do not cross documents and are judged on
    the input. ``length`` must be a multiple of ROUNDS and well above GRAM. Null counts as
    empty; texts shorter than ``length`` keep everything. Repeated rows are each other's
    copies and lose all their windows. Extra columns are not read."""
    if length % ROUNDS or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of {ROUNDS} and at least {2 * GRAM}")
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_hash(text_col).alias("h"))
    spans = repeats(d, length, **kw).withColumnsRenamed({"id": "_id", "h": "_h"})
    joined = d.join(spans, same("id", "_id") & (F.col("h") == F.col("_h")), "left").select("id", "text", "spans")
    fields = [T.StructField("id", d.schema["id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    if keep_bytes:
        fields.append(T.StructField("kept", T.BinaryType()))
    schema = T.StructType(fields)
    return joined.mapInArrow(_strip(schema.names, length), schema).withColumnRenamed("id", id_col)

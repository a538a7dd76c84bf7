"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch: t = ``SIZE`` coordinates are filled in rounds. In the first t rounds every
element is thrown into one hashed bin with a value (round, hash); in the next t rounds all
elements go to the one bin of that round. A bin keeps its least value, so every coordinate is
filled after 2t rounds at the latest, in expectation after about t log t throws, and the
share of equal coordinates of two sketches is concentrated around their sets' Jaccard
similarity at least as well as for independent hashes.

1. Documents with equal shingle sets (a 128-bit digest of the whole set) are one class.
2. Classes that share a band are candidates. In every band bucket the class met by most
   others leads, and only (leader, member) pairs are verified: linear in the bucket, however
   large it is.
3. Components of these links close most buckets. In the others, members outside the
   bucket's largest component are compared with the rest, blockwise (at most ``BLOCK``
   members a side, a bucket's blocks spread over tasks): by their whole sketches first, and
   where these agree in all but ``SLACK`` of the threshold's share, by their full sets. No pair
   of a bucket that could still join two components is left out, each is looked at once, only
   links are given out, and nothing is capped.
4. Every link is confirmed on the full shingle sets.

The band height follows the threshold (``banding``): a link exactly at it shares no band with
probability below 1e-6 (0.85: 32 bands of 6, 3e-7), and misses the sketch agreement, over five
standard deviations below the threshold, with about 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.components import components
from sluice.llm.rows import keep_rows, same, text_hash
from sluice.llm.text import NONSPACE, Buffer, Words, mix64, shingles, slices
from sluice.session import pin

SIZE = 192
BLOCK = 256
MISS = 1e-6
SLACK = 0.15
_SEEDS = mix64(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_LOW = np.uint64(0xFFFFFFFF)


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows): the highest bands that still miss a link at the threshold with
    probability below ``MISS``."""
    for rows in range(SIZE, 1, -1):
        if (1 - similarity**rows) ** (SIZE // rows) < MISS:
            return SIZE // rows, rows
    return SIZE, 1


def _throw(h: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    return mix64(h[None, :] ^ _SEEDS[rounds][:, None])


def sketch(h: np.ndarray) -> np.ndarray:
    """``SIZE`` values (round << 32 | hash) of a non-empty set of distinct 64-bit elements."""
    out = np.full(SIZE, np.iinfo(np.int64).max, dtype=np.int64)
    done, n = 0, len(h)
    enough = int(np.ceil(SIZE * (np.log(SIZE) + 3) / n))
    while done < SIZE and (out == np.iinfo(np.int64).max).any():
        rounds = np.arange(done, min(SIZE, done + max(1, enough)))
        x = _throw(h, rounds)
        bins = ((x >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        value = (rounds[:, None] << 32) | (x & _LOW).astype(np.int64)
        np.minimum.at(out, bins.ravel(), value.ravel())
        done += len(rounds)
        enough = max(1, enough // 4)
    empty = np.flatnonzero(out == np.iinfo(np.int64).max)
    if len(empty):  # the second half: one bin a round takes every element
        x = _throw(h, SIZE + empty) & _LOW
        out[empty] = ((SIZE + empty) << 32) | x.min(axis=1).astype(np.int64)
    return out


_BAND_STEP = np.uint64(0x9E3779B97F4A7C15)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band, of the band's number and its values."""
    grid = mix64(values[: bands * rows].astype(np.uint64)).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix64(key * _BAND_STEP + grid[:, j])
    return key.astype(np.int64)


def signature(values: np.ndarray) -> bytes:
    """One byte per coordinate."""
    return (mix64(values.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = Words(Buffer(texts), NONSPACE)
    doc, h = shingles(words, k)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return np.split(h, np.searchsorted(doc, np.arange(1, len(texts))))


def _digest(h: np.ndarray) -> bytes:
    return hashlib.sha256(h.tobytes()).digest()[:16]


def _sketches(names: list[str], k: int, bands: int, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in slices(batch, "text"):
                sizes, digests, keys, sigs = [], [], [], []
                for h in shingle_sets(texts, k):
                    sizes.append(len(h))
                    if not len(h):
                        digests.append(None), keys.append(None), sigs.append(None)
                        continue
                    values = sketch(h)
                    digests.append(_digest(h)), keys.append(band_keys(values, bands, height)), sigs.append(signature(values))
                part = batch.slice(row, len(texts))
                new = {"n": pa.array(sizes, pa.int64()), "c": pa.array(digests, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())), "sig": pa.array(sigs, pa.binary())}
                yield pa.RecordBatch.from_arrays([new[x] if x in new else part.column(part.schema.get_field_index(x)) for x in names], names)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                found = [h for h in shingle_sets(texts, k) if len(h)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(h) for h in found], pa.binary()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], ["c", "elements"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = len(a) - 1
    return int((a[at] == b).sum())


def _link_block(rows: list[tuple], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links of one block: rows (key, inner, side, c, label, keys, sig, elements). A pair is
    looked at in the first band it shares only, so once in all blocks; pairs already joined by
    a link of this block are passed over, the likeliest ones come first."""
    need = int(np.ceil((percent / 100 - SLACK) * SIZE))
    key, inner = rows[0][:2]
    _, root = np.unique([r[4].hex() for r in rows], return_inverse=True)
    if root.max() == 0:
        return
    sig = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint8).reshape(len(rows), SIZE)
    keys = np.array([r[5] for r in rows])
    size = np.array([len(r[7]) for r in rows])
    band = int(np.flatnonzero(keys[0] == key)[0])
    left = np.array([r[2] == 0 for r in rows])
    for i in np.flatnonzero(left):
        other = (np.arange(len(rows)) > i) if inner else ~left
        other &= (root != root[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        at = np.flatnonzero(other)
        if not len(at):
            continue
        alike = (sig[at] == sig[i]).sum(axis=1)
        first = (keys[at] == keys[i]).argmax(axis=1) == band
        ok = first & (alike >= need)
        at = at[ok][np.argsort(-alike[ok], kind="stable")]
        for j in at:
            if root[i] == root[j]:
                continue
            both = _common(rows[i][7], rows[j][7])
            if 100 * both >= percent * (size[i] + size[j] - both):
                yield rows[i][3], rows[j][3]
                root[root == root[j]] = root[i]


def _blocks(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block (key, inner, x, y); yields the links (a, b) found in them."""

    def emit(pairs):
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    held, at = [], None
    for batch in batches:
        col = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
        plain = {n: col[n].to_pylist() for n in ("key", "inner", "x", "y", "side", "c", "label", "sig")}
        views = {}
        for n in ("keys", "elements"):
            values, cut = col[n].values.to_numpy(zero_copy_only=False), col[n].offsets.to_numpy()
            views[n] = [values[cut[i] : cut[i + 1]] for i in range(len(cut) - 1)]
        out = []
        for i in range(batch.num_rows):
            block = tuple(plain[n][i] for n in ("key", "inner", "x", "y"))
            if block != at:
                out += _link_block(held, percent) if held else []
                held, at = [], block
            # unsigned order, as the sets are sorted
            held.append((block[0], block[1], plain["side"][i], plain["c"][i], plain["label"][i], views["keys"][i], plain["sig"][i], views["elements"][i].view(np.uint64)))
        held = [(*r[:5], r[5].copy(), r[6], r[7].copy()) for r in held]  # the batch's memory goes
        yield emit(out)
    yield emit(list(_link_block(held, percent)) if held else [])


class Near:
    """One run over ``docs``: sketches, classes and verified links between classes."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int):
        self.k, self.percent = shingle, percent
        d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_hash(text_col).alias("h"))
        self.texts, self.id_type = d, d.schema["id"].dataType
        long = lambda c: T.StructField(c, T.LongType())
        schema = T.StructType([
            T.StructField("id", self.id_type), long("h"), long("n"), T.StructField("c", T.BinaryType()),
            T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
        self.rows = pin(d.mapInArrow(_sketches(schema.names, shingle, *banding(percent / 100)), schema), "sketches")
        have = self.rows.where(F.col("c").isNotNull())
        # the row that stands for a class: the smallest id (null last), then text hash
        best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("best")
        self.classes = pin(
            have.groupBy("c").agg(best, F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("sig").alias("sig")),
            "classes")

    def _may_link(self, a: str, b: str):
        """Sizes allow the similarity."""
        return 100 * F.least(F.col(a), F.col(b)) >= self.percent * F.greatest(F.col(a), F.col(b))

    def sets(self, classes: DataFrame) -> DataFrame:
        """Full shingle sets (c, elements) of the classes, made from their documents."""
        ids = self.classes.join(classes, "c", "left_semi").select(F.col("best.id").alias("_id"), F.col("best.h").alias("_h")).distinct()
        texts = self.texts.join(ids, same("id", "_id") & (F.col("h") == F.col("_h")), "left_semi").select("text")
        found = texts.mapInArrow(_sets(self.k), "c binary, elements array<long>")
        return pin(found.join(classes, "c", "left_semi").groupBy("c").agg(F.any_value("elements").alias("elements")), "sets")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose full sets are similar enough."""
        pairs = pin(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        one = lambda c: sets.select(F.col("c").alias(f"_{c}"), F.col("elements").alias(f"set_{c}"))
        both = pairs.join(one("a"), F.col("a") == F.col("_a")).join(one("b"), F.col("b") == F.col("_b"))
        common = F.size(F.array_intersect("set_a", "set_b"))
        both = both.withColumns({"common": common, "total": F.size("set_a") + F.size("set_b")})
        return pin(both.where(F.col("common") * 100 >= self.percent * (F.col("total") - F.col("common"))).select("a", "b"), "links")

    def links(self) -> DataFrame:
        """Verified links (a, b) that give the same components as all links do."""
        banded = self.classes.select("c", "n", F.explode("keys").alias("key"))
        shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        buckets = pin(banded.join(shared, "key"), "buckets")
        met = buckets.groupBy("c").agg(F.sum("m").alias("met")).withColumnRenamed("c", "_c")
        lead = buckets.join(met, F.col("c") == F.col("_c")).groupBy("key").agg(F.max(F.struct("met", "c", "n")).alias("lead"))
        lead = pin(lead.select("key", F.col("lead.c").alias("lead"), F.col("lead.n").alias("lead_n")), "leads")
        stars = buckets.join(lead, "key").where((F.col("c") != F.col("lead")) & self._may_link("n", "lead_n"))
        sets = self.sets(buckets.select("c").distinct())
        links = self.verified(stars.select(F.col("lead").alias("a"), F.col("c").alias("b")), sets)
        more = self._across(buckets, lead, components(links), sets)
        return links if more is None else links.union(more)

    def _across(self, buckets: DataFrame, lead: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame | None:
        """Links between different components within a bucket, leaders (whose pairs are
        verified) left out."""
        label = label.withColumnRenamed("node", "_c")
        rest = buckets.join(lead.select("key", "lead"), "key").where("c <> lead").select("key", "c", "n")
        rest = rest.join(label, F.col("c") == F.col("_c"), "left").select("key", "c", "n", F.coalesce("root", "c").alias("label"))
        span = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        open_ = pin(rest.join(span, "key"), "open")
        if open_.isEmpty():
            return None
        tally = open_.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
        tally = tally.groupBy("key").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all"))
        tally = pin(tally.select("key", F.col("top.label").alias("top"), F.col("top.k").alias("inside"), (F.col("all") - F.col("top.k")).alias("outside")), "tally")
        blocks = lambda c: F.expr(f"({c} + {BLOCK - 1}) div {BLOCK}")
        m = open_.join(tally, "key").withColumns({"nx": blocks("outside"), "ny": blocks("inside"), "out": F.col("label") != F.col("top")})
        nth = F.pmod(F.xxhash64("c"), F.when(F.col("out"), F.col("nx")).otherwise(F.col("ny")))
        m = m.withColumn("nth", nth)
        upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        place = lambda inner, x, y, side: F.struct(F.lit(inner).alias("inner"), x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(side).alias("side"))
        nth = F.col("nth")
        # outside members meet each other (inner blocks) and the largest component's members
        inner = F.transform(upto("nx"), lambda y: place(True, F.least(nth, y), F.greatest(nth, y), 0))
        left = F.transform(upto("ny"), lambda y: place(False, nth, y, 0))
        right = F.transform(upto("nx"), lambda x: place(False, x, nth, 1))
        m = m.withColumn("at", F.explode(F.when(F.col("out"), F.concat(inner, left)).otherwise(right)))
        of = self.classes.select(F.col("c").alias("_c"), "keys", "sig").join(sets.withColumnRenamed("c", "_e"), F.col("_c") == F.col("_e"))
        m = m.select("key", "c", "label", "at.*").join(of, F.col("c") == F.col("_c")).drop("_c", "_e")
        sides = ["key", "inner", "x", "y"]
        m = m.repartition(*sides).sortWithinPartitions(*sides)
        return pin(m.mapInArrow(partial(_blocks, self.percent), "a binary, b binary"), "links")

    def result(self, id_col: str) -> DataFrame:
        roots = components(self.links()).withColumnRenamed("node", "_c")
        member = self.classes.select("c", "best").join(roots, F.col("c") == F.col("_c"), "left").select("c", "best", F.coalesce("root", "c").alias("root"))
        least = member.groupBy("root").agg(F.min("best").alias("least")).withColumnRenamed("root", "_r")
        named = member.join(least, F.col("root") == F.col("_r"))
        named = pin(named.select(F.col("c").alias("_c"), F.col("least.id").alias("component"), F.col("least.h").alias("stay_h")), "components")
        out = self.rows.select("id", "h", "n", "c").join(named, F.col("c") == F.col("_c"), "left")
        component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
        return out.select(
            F.col("id").alias(id_col), F.col("h").alias("text_hash"), F.col("n").alias("n_shingles"), component.alias("component_id"),
            F.col("id").eqNullSafe(component).alias("kept"),
            (F.col("c").isNull() | (same("id", "component") & (F.col("h") == F.col("stay_h")))).alias("stays"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, n_shingles, component_id (smallest id
    reachable over links, itself included), kept (id = component_id), stays (the one row, by id
    and text, that is left of its component: the smallest id, null last, then text hash).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its distinct
    ``shingle``-word runs, or its whole sequence when it has fewer words. Documents are
    linked where 100 * intersection >= percent * union. Null, empty and blank texts have no
    set and no links: each of them is kept and stays. Rows with a null id have links like
    others; their component_id is null and kept is true, whether they stay or not.
    Rows are judged by their own text; repeated rows share a verdict; a repeated id with
    different texts is judged per text. Extra columns are not read."""
    return Near(docs, id_col, text_col, shingle, percent).result(id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that stay by ``near_groups``: one of every component,
    and those without a set; of repeated rows one."""
    kept = near_groups(docs, id_col, text_col, **kw).where("stays")
    return keep_rows(docs, kept.select(F.col(id_col).alias("id"), F.col("text_hash").alias("h")), id_col, text_col)



"""Exact dedup by composable polynomial fingerprints and chunkwise comparison.

A text is normalised by deleting ``[\\x20\\x09-\\x0D]``. Its fingerprint is its length and the
value of its bytes as a polynomial modulo 2**31 - 1 at two points. Fingerprints compose:
``combine(a, b)`` shifts a by the length of b and adds b, so chunks of one text are hashed
independently (rows over ``split_chars`` are cut into slices hashed by different tasks) and
combined afterwards.

Texts with equal fingerprints are compared with their group's best row chunk by chunk: the
join carries (group row, chunk number) and ``CHUNK`` bytes, never a whole text. Rows that
differ from it although the fingerprint is the same form the next round, until none is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.rows import keep_rows, same, text_hash
from sluice.session import pin

PRIME = (1 << 31) - 1
POINTS = (1_000_003, 777_767_777)
SPACE = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 16
BLOCK = 4096
SPLIT_CHARS = 16 << 20

_POWERS = {}


def _powers(point: int) -> np.ndarray:
    if point not in _POWERS:
        out = np.ones(BLOCK, dtype=np.uint64)
        for i in range(1, BLOCK):
            out[i] = int(out[i - 1]) * point % PRIME
        _POWERS[point] = out[::-1].copy()
    return _POWERS[point]


def fingerprint(data: bytes) -> tuple[int, int, int]:
    """(length, value at point 1, value at point 2); bytes count as 1 to 256."""
    n = len(data)
    head, blocks = n % BLOCK, n // BLOCK
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    out = [n]
    for point in POINTS:
        w = _powers(point)
        value = int((codes[:head] * w[BLOCK - head :]).sum() % PRIME) if head else 0
        if blocks:
            shift = pow(point, BLOCK, PRIME)
            # each product is below 2**39, so a block's sum fits 64 bits
            for part in (codes[head:].reshape(blocks, BLOCK) @ w) % PRIME:
                value = (value * shift + int(part)) % PRIME
        out.append(value)
    return tuple(out)


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint of two texts back to back, from theirs."""
    return (a[0] + b[0], *((x * pow(p, b[0], PRIME) + y) % PRIME for p, x, y in zip(POINTS, a[1:], b[1:], strict=True)))


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACE)


def _hash_rows(names: list[str], digest: bool):
    """Adds m, f1, f2 (and the digest of the normalised text) to rows that have ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, shas = [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                data = normalised(text.as_py())
                fps.append(fingerprint(data))
                if digest:
                    shas.append(hashlib.sha256(data).hexdigest())
            new = {k: pa.array([f[i] for f in fps], pa.int64()) for i, k in enumerate(("m", "f1", "f2"))}
            new["sha256"] = pa.array(shas, pa.string())
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in names], names)

    return run


def _chunks(names: list[str], chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, idx, data = [], [], []
            held = 0

            def flush():
                rows = batch.take(pa.array(at, pa.int64()))
                new = {"idx": pa.array(idx, pa.int64()), "chunk": pa.array(data, pa.binary())}
                return pa.RecordBatch.from_arrays([new[c] if c in new else rows.column(rows.schema.get_field_index(c)) for c in names], names)

            for i, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                whole = normalised(text.as_py())
                for k, start in enumerate(range(0, max(1, len(whole)), chunk)):
                    at.append(i), idx.append(k), data.append(whole[start : start + chunk])
                held += len(whole)
                if held > 1 << 22:
                    yield flush()
                    at, idx, data, held = [], [], [], 0
            if at:
                yield flush()

    return run


def _combine_slices(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
                whole = (0, 0, 0)
                for p in sorted(parts, key=lambda p: p["pos"]):
                    whole = combine(whole, (p["m"], p["f1"], p["f2"]))
                out.append(whole)
            new = {k: pa.array([f[i] for f in out], pa.int64()) for i, k in enumerate(("m", "f1", "f2"))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in names], names)

    return run


def fingerprints(d: DataFrame, split_chars: int = SPLIT_CHARS, digest: bool = True) -> DataFrame:
    """Rows (id, h, n_chars, m, f1, f2, sha256) of rows (id, h, text); h hashes the text."""
    id_type = d.schema["id"].dataType
    long = lambda *cs: [T.StructField(c, T.LongType()) for c in cs]
    fp = T.StructType([T.StructField("id", id_type), *long("h", "n_chars", "m", "f1", "f2"), T.StructField("sha256", T.StringType())])
    sized = d.withColumn("n_chars", F.length("text").cast("long"))
    short = sized.where(F.col("n_chars") <= split_chars).mapInArrow(_hash_rows(fp.names, digest), fp)
    huge = sized.where(F.col("n_chars") > split_chars)
    cut = huge.select("id", "h", F.posexplode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.expr(f"(n_chars - 1) div {split_chars}")),
        lambda i: F.substring(F.col("text"), (i * split_chars + 1).cast("int"), F.lit(split_chars)))).alias("pos", "text"))
    piece = T.StructType([T.StructField("id", id_type), *long("h"), T.StructField("pos", T.IntegerType()), *long("m", "f1", "f2")])
    hashed = cut.repartition("id", "h", "pos").mapInArrow(_hash_rows(piece.names, False), piece)
    parts = hashed.groupBy("id", "h").agg(F.collect_set(F.struct("pos", "m", "f1", "f2")).alias("parts"))
    whole = T.StructType([T.StructField("id2", id_type), *long("h2", "m", "f1", "f2")])
    joined = parts.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "parts").mapInArrow(_combine_slices(whole.names), whole)
    digest_col = F.sha2(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""), 256) if digest else F.lit("")
    large = huge.select("id", "h", "n_chars", digest_col.alias("sha256")).join(joined, same("id", "id2") & (F.col("h") == F.col("h2")))
    return short.unionByName(large.select(*fp.names))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """One row per row of ``docs``: id, text_hash (of the original text), keep_id,
    keep_hash (text_hash of the row that stays), group_size, kept, text_sha256 (normalised
    text).

    Of equal normalised texts the row with the most code points in its original text stays,
    then the smallest id (a null id sorts first). Null counts as empty, so all null, empty
    and white-space texts are one group. A row is ``kept`` when its id is the group's
    keep_id; repeated rows of that id and text count in group_size and share the verdict.
    An id may repeat with texts that differ in white space: keep_hash tells which one stays.
    Extra columns are not read."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", text_hash("text"))
    fp = pin(fingerprints(d, split_chars), "fingerprints")
    best = F.min(F.struct((-F.col("n_chars")).alias("k"), "id", "h")).alias("best")
    key = ["m", "f1", "f2"]
    # pinned, as the other grouped join sides below: a join on a group's key then has exchanges
    # of its own, which Spark splits where a group is hot
    groups = pin(fp.groupBy(*key).agg(best, F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    todo = fp.join(groups, key).select(
        "id", "h", "n_chars", *key, F.col("best.id").alias("lead_id"), F.col("best.h").alias("lead_h"))
    id_type = d.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("h", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("chunk", T.BinaryType())])
    wanted = todo.select(F.col("id").alias("id2"), F.col("h").alias("h2")).distinct()
    chunks = pin(d.join(wanted, same("id", "id2") & (F.col("h") == F.col("h2")), "left_semi").mapInArrow(_chunks(schema.names, chunk), schema), "chunks")
    settled = None
    while True:
        todo = pin(todo, "equal-prints")
        leads = todo.select("lead_id", "lead_h").distinct()
        lead_chunks = chunks.join(leads, same("id", "lead_id") & (F.col("h") == F.col("lead_h")), "left_semi").groupBy("id", "h", "idx").agg(F.first("chunk").alias("lead_chunk"))
        lead_chunks = pin(lead_chunks.withColumnsRenamed({"id": "l_id", "h": "l_h", "idx": "l_idx"}), "lead-chunks")
        pairs = todo.select("id", "h", "lead_id", "lead_h").distinct().withColumnsRenamed({"id": "t_id", "h": "t_h"})
        mine = chunks.join(pairs, same("id", "t_id") & (F.col("h") == F.col("t_h")))
        compared = mine.join(lead_chunks, same("lead_id", "l_id") & (F.col("lead_h") == F.col("l_h")) & (F.col("idx") == F.col("l_idx")), "left")
        verdict = compared.groupBy("id", "h").agg(F.bool_and(F.coalesce(F.col("chunk") == F.col("lead_chunk"), F.lit(False))).alias("same"))
        verdict = pin(verdict.withColumnsRenamed({"id": "v_id", "h": "v_h"}), "compared")
        judged = todo.join(verdict, same("id", "v_id") & (F.col("h") == F.col("v_h"))).drop("v_id", "v_h")
        agreed = judged.where("same").select("id", "h", "lead_id", "lead_h")
        settled = agreed if settled is None else settled.unionByName(agreed)
        if verdict.where("NOT same").isEmpty():
            break
        left = judged.where("NOT same").drop("lead_id", "lead_h", "same")
        nexts = pin(left.groupBy(*key).agg(best), "next-leads")
        todo = left.join(nexts, key).select("id", "h", "n_chars", *key, F.col("best.id").alias("lead_id"), F.col("best.h").alias("lead_h"))
    sizes = pin(settled.groupBy("lead_id", "lead_h").agg(F.count(F.lit(1)).alias("size")).withColumnsRenamed({"lead_id": "s_id", "lead_h": "s_h"}), "sizes")
    found = settled.distinct().join(sizes, same("lead_id", "s_id") & (F.col("lead_h") == F.col("s_h")))
    found = found.select(F.col("id").alias("g_id"), F.col("h").alias("g_h"), "lead_id", "lead_h", "size", F.lit(True).alias("grouped"))
    out = fp.join(found, same("id", "g_id") & (F.col("h") == F.col("g_h")), "left")
    keep = F.when(F.col("grouped"), F.col("lead_id")).otherwise(F.col("id"))
    keep_hash = F.when(F.col("grouped"), F.col("lead_h")).otherwise(F.col("h"))
    return out.select(
        F.col("id").alias(id_col), F.col("h").alias("text_hash"), keep.alias("keep_id"), keep_hash.alias("keep_hash"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha256").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of every group of ``exact_groups``, all columns: of rows with the kept id the
    one with the kept text, of rows that repeat both any one."""
    kept = exact_groups(docs, id_col, text_col, **kw).where("kept AND text_hash = keep_hash")
    return keep_rows(docs, kept.select(F.col(id_col).alias("id"), F.col("text_hash").alias("h")), id_col, text_col)

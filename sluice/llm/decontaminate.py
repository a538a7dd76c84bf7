"""Benchmark decontamination: prefix-filtered containment join of item windows.

Every benchmark item is cut into windows of ``window`` consecutive words (an item of fewer
words, but not none, is one window). A window is a set of word shingles that a document
window of the same size must contain in full, so its necessary prefix is one token: the
window's rarest shingle, by occurrences over the whole corpus. Documents look their shingles
up among those prefix tokens; a hit fixes the only possible alignment, which is kept when it
lies inside the document (position and length bound) and then verified word by word.

Scale: the benchmark side is the stated query set. It is cut into blocks of at most
``block_bytes`` of item text (hash of the item id), and only one block's windows are
broadcast at a time; every block meets every document row. Documents are never shuffled or
collected: their matches stay in their own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.text import ALNUM, Buffer, Lookup, Words, ranges, run_hash, slices

SHINGLE = 3
BLOCK_BYTES = 16 << 20


class WindowIndex:
    """Windows of one block of items: distinct windows (word hashes padded to ``window``),
    the items each belongs to, and postings of their candidate shingles."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window = window
        words = Words(Buffer([t for _, t in items]), ALNUM)
        n = words.counts()
        self.ids = [i for i, _ in items]
        per = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), per)
        start = ranges(words.first[:-1], per)
        size = np.minimum(n, window)[item]
        grid = np.zeros((len(item), window), dtype=np.uint64)
        at = ranges(start, size)
        grid[np.repeat(np.arange(len(item)), size), ranges(np.zeros(len(size), np.int64), size)] = words.hash[at]
        keyed = np.column_stack((size.astype(np.uint64), grid))
        distinct, which = np.unique(keyed, axis=0, return_inverse=True)
        which = which.ravel()
        self.size = distinct[:, 0].astype(np.int64)
        self.grid = np.ascontiguousarray(distinct[:, 1:])
        pairs = np.unique(np.column_stack((which, item)), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.item_of = pairs[:, 1]
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        self._shingles()

    def _shingles(self) -> None:
        """Per window: its shingles (hash, offset); shorter windows are one shingle."""
        win, off, key = [], [], []
        for m in range(1, SHINGLE + 1):
            rows = np.flatnonzero(self.size == m if m < SHINGLE else self.size >= SHINGLE)
            for o in range(self.window - m + 1):
                sel = rows[self.size[rows] >= o + m]
                if not len(sel):
                    break
                h = np.zeros(len(sel), dtype=np.uint64)
                flat = run_hash(np.ascontiguousarray(self.grid[sel][:, o : o + m]).ravel(), m)
                h = flat[::m] if len(flat) else h
                win.append(sel), off.append(np.full(len(sel), o)), key.append(h)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.cand_win, self.cand_off, self.cand_key = cat(win, np.int64), cat(off, np.int64), cat(key, np.uint64)
        self.vocab = np.unique(self.cand_key)

    def choose_prefix(self, seen: np.ndarray) -> None:
        """Keep one posting per window: its rarest shingle. ``seen`` counts the vocabulary
        over the corpus; a window with a shingle that never occurs cannot occur."""
        rarity = seen[np.searchsorted(self.vocab, self.cand_key)]
        order = np.lexsort((self.cand_off, self.cand_key, rarity, self.cand_win))
        first = order[np.unique(self.cand_win[order], return_index=True)[1]]
        first = first[rarity[first] > 0]
        first = first[np.argsort(self.cand_key[first], kind="stable")]
        key = self.cand_key[first]
        self.post_win, self.post_off = self.cand_win[first], self.cand_off[first]
        tokens, at = np.unique(key, return_index=True)
        self.lookup, self.post_from = Lookup(tokens), np.concatenate((at, [len(key)]))
        self.cand_win = self.cand_off = self.cand_key = self.vocab = None

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every verified occurrence in the buffer's words."""
        starts, wins = [], []
        for m in range(1, SHINGLE + 1):
            at, slot = self.lookup.hits(run_hash(words.hash, m))
            fan = self.post_from[slot + 1] - self.post_from[slot]
            post = ranges(self.post_from[slot], fan)
            win = self.post_win[post]
            start = np.repeat(at, fan) - self.post_off[post]
            doc = words.doc[np.repeat(at, fan)] if len(at) else np.zeros(0, np.int64)
            # position and length bound: the window must lie inside its document
            ok = (start >= words.first[doc]) & (start + self.size[win] <= words.first[doc + 1])
            if m < SHINGLE:
                ok &= self.size[win] == m
            start, win = start[ok], win[ok]
            for j in range(self.window):  # verify word by word, dropping failures early
                inside = j < self.size[win]
                same = ~inside
                same[inside] = words.hash[start[inside] + j] == self.grid[win[inside], j]
                start, win = start[same], win[same]
            starts.append(start), wins.append(win)
        return np.concatenate(starts), np.concatenate(wins)


def _count_shingles(index, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = index.value.vocab
        lookup, total = Lookup(vocab), np.zeros(len(vocab), dtype=np.int64)
        for batch in batches:
            for _, texts in slices(batch, column):
                words = Words(Buffer(texts), ALNUM)
                for m in range(1, SHINGLE + 1):
                    total += np.bincount(lookup.hits(run_hash(words.hash, m))[1], minlength=len(vocab))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "seen"])

    return run


def _match(index, columns: list[str], column: str, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for row, texts in slices(batch, column):
                words = Words(Buffer(texts), ALNUM)
                start, win = ix.matches(words)
                doc = words.doc[start] if len(start) else start
                part = batch.slice(row, len(texts))
                local = start - words.first[doc] if len(start) else start
                size = ix.size[win]
                spans = np.unique(np.column_stack((doc, local, local + size)), axis=0)
                fan = ix.item_from[win + 1] - ix.item_from[win]
                item = ix.item_of[ranges(ix.item_from[win], fan)]
                found = np.unique(np.column_stack((np.repeat(doc, fan), item)), axis=0)
                cut = np.searchsorted(spans[:, 0], np.arange(len(texts) + 1))
                cut_i = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
                pair = pa.StructArray.from_arrays([pa.array(spans[:, 1]), pa.array(spans[:, 2])], ["a", "b"])
                ids = pa.array([ix.ids[i] for i in found[:, 1]], type=pa.string())
                new = {
                    "n_words": pa.array(words.counts()),
                    "spans": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pair),
                    "items": pa.ListArray.from_arrays(pa.array(cut_i, pa.int32()), ids),
                }
                if not first:  # add to what earlier blocks found
                    for name in ("spans", "items"):
                        old = part.column(part.schema.get_field_index(name)).to_pylist()
                        both = [[*a, *b] for a, b in zip(old, new[name].to_pylist(), strict=True)]
                        new[name] = pa.array(both, type=new[name].type)
                arrays = [new[c] if c in new else part.column(part.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return run


def _scan(docs: DataFrame, items: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int, keep_text: bool) -> DataFrame:
    """``docs`` has columns id (any type) and text; adds n_words, spans and items to each row."""
    spark = docs.sparkSession
    b = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    spans = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    types = {"id": docs.schema["id"].dataType, "text": T.StringType(), "n_words": T.LongType(), "spans": spans, "items": T.ArrayType(T.StringType())}
    found = docs
    for k in range(blocks):
        part = b.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else b
        index = WindowIndex(sorted(((r.item, r.text.encode()) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or "", x[1])), window)
        shared = spark.sparkContext.broadcast(index)
        counts = docs.select("text").mapInArrow(_count_shingles(shared, "text"), "token long, seen long")
        seen = np.zeros(len(index.vocab), dtype=np.int64)
        # at most one row per shingle of this block's items
        for r in counts.groupBy("token").agg(F.sum("seen").alias("seen")).toLocalIterator():
            seen[r.token] = r.seen
        index.choose_prefix(seen)
        shared = spark.sparkContext.broadcast(index)
        columns = ["id", "n_words", "spans", "items"]
        if keep_text or k < blocks - 1:
            columns.insert(1, "text")
        found = found.mapInArrow(_match(shared, columns, "text", k == 0), T.StructType([T.StructField(c, types[c]) for c in columns]))
    # words covered by the union of the spans: spans sorted by start, each adds what lies
    # past the furthest end so far
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["b"]).alias("upto")),
        lambda acc: acc["n"])
    return found.withColumns({"items": F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))), "n_hit": covered})


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit (words inside an occurrence of any
    item window), n_items, items (sorted item ids as text), spans (word ranges [a, b) of the
    occurrences).

    Words are lower-cased (A-Z) runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null and empty
    texts have no words and no hits; items without words have no windows; an empty
    benchmark gives zero hits. A null item id is left out of ``items`` but its windows count
    as hits. Repeated document rows each get their row; items with the same text all count.
    Extra columns of either input are not read."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _scan(d, items, item_col, item_text_col, window, block_bytes, keep_text=False)
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans")


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    """Contract rule: at least one hit word and at least one word in twenty hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text is not contaminated. The verdict is
    computed on the row itself, so nothing is joined back; repeated rows share a verdict and
    rows with null or empty text stay."""
    rest = [c for c in docs.columns if c != text_col]
    d = docs.select(F.struct(*rest).alias("id"), F.col(text_col).alias("text"))
    found = _scan(d, items, item_col, item_text_col, window, block_bytes, keep_text=True)
    kept = found.where(~is_contaminated())
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("id")[c].alias(c) for c in docs.columns])

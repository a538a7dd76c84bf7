"""Vectorised text helpers for Arrow batches inside Spark tasks.

A batch's texts are handled as one byte buffer (each text followed by one separator byte),
so word boundaries, word hashes and shingle hashes come from whole-buffer numpy passes
instead of per-word Python. Buffers are cut at document borders into slices of about
``SLICE_BYTES``, which bounds a task's memory by the slice and the longest single text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_M64 = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15  # odd multiplier of the polynomial word hash
INVERSE = pow(ODD, -1, 1 << 64)

#: Deletes A-Z case: bytes A-Z become a-z, every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Word bytes of [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

ALNUM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))

_powers: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown as needed and kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, SLICE_BYTES + (1 << 16)), dtype=np.uint64)
        out[1:] = np.uint64(base & _M64)
        _powers[base] = have = np.multiply.accumulate(out)
    return have


class Buffer:
    """Texts back to back with one separator after each. ``starts[i]``, ``ends[i]`` bound
    text i; nulls are empty texts."""

    __slots__ = ("data", "starts", "ends")

    def __init__(self, texts: list[bytes], separator: bytes = b"\x20"):
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.data = np.frombuffer(separator.join(texts) + separator, dtype=np.uint8)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive runs of rows holding about ``limit`` text bytes."""
    texts = text_bytes(batch.column(batch.schema.get_field_index(column)))
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


class Words:
    """Words of a buffer: ``doc`` (text index), ``start``/``end`` (buffer bytes), ``hash``
    and ``first`` (first word of text i; one more entry than texts)."""

    __slots__ = ("doc", "start", "end", "hash", "first")

    def __init__(self, buf: Buffer, is_word: np.ndarray, lower: bool = True):
        data = LOWER[buf.data] if lower else buf.data
        inside = is_word[data]
        inside[buf.ends] = False  # the separator after each text
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        n = len(data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODE[data] * power_table(ODD, n)[:n], out=total[1:])
        raw = (total[self.end] - total[self.start]) * power_table(INVERSE, n + 1)[self.start]
        self.hash = mix64(raw + (self.end - self.start).astype(np.uint64) * np.uint64(ODD))
        self.first = np.searchsorted(self.start, np.concatenate((buf.starts, [n]))).astype(np.int64)
        self.doc = np.repeat(np.arange(len(buf.starts)), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_STEP = 0xD6E8FEB86659FD93  # odd


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive word hashes (length n - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(_STEP) + h[j : j + n]
    return mix64(out + np.uint64(k))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of k words; a text of 1 to k-1 words is one run."""
    h = run_hash(words.hash, k)
    n = words.counts()
    keep = np.zeros(len(words.hash), dtype=bool)
    keep[: len(h)] = True
    for back in range(1, k):  # runs that would cross into the next text
        last = words.first[1:] - back
        ok = last >= words.first[:-1]
        keep[last[ok]] = False
    at = np.flatnonzero(keep)
    docs, hashes = words.doc[at], h[at]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            at = words.first[short]
            docs = np.concatenate((docs, short))
            hashes = np.concatenate((hashes, run_hash(words.hash, m)[at]))
    return docs, hashes


class Lookup:
    """Position of 64-bit keys in a sorted unique key array, -1 where absent. A bit table
    on the low bits answers most absent keys without a binary search."""

    __slots__ = ("keys", "mask", "table")

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(12, min(27, int(np.ceil(np.log2(len(keys) + 1))) + 5))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(keys & self.mask).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, positions in keys) of the entries of h that are keys."""
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[slot] == h[at]
        return at[same], slot[same]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges start .. start+length-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift

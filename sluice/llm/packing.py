"""Sum-of-squares packing of documents into sequences of ``width`` token ids.

Every document is its token ids and an end id. A document longer than a sequence gives full
sequences and a rest; rests and shorter documents are placed whole, one after the other, as
they are read. A level array counts the open (partly filled) sequences of every fill level; a
piece goes to the level, an empty sequence included, after which the sum of the squared counts
is least (ties: the fullest), so no fill level piles up that later pieces could not complete.

Documents are cut beyond that only in two places. With ``most_open`` sequences open, the next
piece first completes the fullest ones, which bounds what a task holds. At the end of a task
the fullest open sequences are completed from the emptiest until one is left, and that one is
cut into sequences whose lengths are powers of two. So every sequence is full or as long as a
power of two: none needs padding, and a task ends with at most log2(width) short ones.

Scale: a task packs the rows it reads; nothing is shuffled and no task waits for another.
Sequence numbers hold the task's number, so they are unique without counting. A task's result
comes whole from its input rows: when it runs again, its sequences are replaced together.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.tokencount import SPLIT

WIDTH = 1024
MOST_OPEN = 512
STRETCH = 1 << 18  # characters of a text looked at in one go
LONG_WORD = 1000
FLUSH_ROWS, FLUSH_BYTES = 4096, 8 << 20
_ID_BYTES = 4


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the other bytes in order for characters from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def settled_characters() -> frozenset[str]:
    """Characters on which Unicode tables of any age agree: ASCII but for the four information
    separators, and letters, marks, numbers, punctuation and symbols of Unicode 3.2 that are of
    the same kind today."""
    old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
    rest = (chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x30000)))
    return frozenset(map(chr, (*range(28), *range(32, 128)))) | {c for c in rest if old(c)[0] in "LMNPS" and old(c)[0] == now(c)[0]}


def _le(ids: list[int]) -> bytes:
    return np.asarray(array("I", ids)).astype("<u4", copy=False).tobytes()


class Encoder:
    """Token ids of texts, as the tokenizer of one vocabulary file gives them, as little-endian
    unsigned 32-bit numbers.

    The vocabulary goes to two libraries: the one that reads the file (exact for every text,
    slower), and a faster one for stretches of settled characters, whose split into pre-tokens
    cannot depend on a library's Unicode tables. The faster one is used only where the file has
    the plain form it can take: this split rule, and ids that rise with the order of merges."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        data = json.loads(spec)
        self.own = Tokenizer.from_str(spec)
        self.specials = [t["content"] for t in data["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.fast, self.settled = self._fast(data), settled_characters()

    def _fast(self, data: dict):
        import tiktoken

        model, rule = data["model"], data.get("pre_tokenizer") or {}
        plain = data.get("normalizer") is None and model.get("type") == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or not rule.get("use_regex", True):
            return None
        vocab, special = model["vocab"], {t["id"] for t in data["added_tokens"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        order = [vocab[a + b] for a, b in pairs]
        byte = _byte_of()
        if any(x >= y for x, y in zip(order, order[1:], strict=False)) or len(order) + 256 != len(set(vocab.values()) - special):
            return None
        ranks = {bytes(byte[c] for c in token): n for token, n in vocab.items() if n not in special}
        return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _stretches(self, text: str) -> Iterator[str]:
        """Runs of about STRETCH characters: a space after a letter or digit always starts a
        pre-token, whatever follows."""
        at = 0
        while len(text) - at > STRETCH:
            cut = text.find(" ", at + STRETCH)
            while cut > 0 and not (text[cut - 1].isascii() and text[cut - 1].isalnum()):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _encode(self, stretch: str) -> bytes:
        # the faster library slows down on very long words
        if self.fast and self.settled.issuperset(stretch) and max(map(len, stretch.split()), default=0) <= LONG_WORD:
            return _le(self.fast.encode_ordinary(stretch))
        return _le(self.own.encode(stretch, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        parts = self.special.split(text) if self.special else [text]
        out = [self._encode(s) for s in self._stretches(parts[0])]
        if len(parts) > 1:
            for mark, part in zip(self.special.findall(text), parts[1:], strict=True):
                out += [_le(self.own.encode(mark, add_special_tokens=False).ids), *map(self._encode, self._stretches(part))]
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder_of(spec: str) -> Encoder:
    """Built once per Python worker."""
    return Encoder(spec)


class Document:
    __slots__ = ("id", "tokens")

    def __init__(self, id_, tokens: int):
        self.id, self.tokens = id_, tokens


class Piece:
    """A run of a document's ids: the document, ids before it, its own ids."""

    __slots__ = ("doc", "start", "ids")

    def __init__(self, doc: Document, start: int, ids: memoryview):
        self.doc, self.start, self.ids = doc, start, ids

    def __len__(self) -> int:
        return len(self.ids) // _ID_BYTES

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: n * _ID_BYTES]), Piece(self.doc, self.start + n, self.ids[n * _ID_BYTES :])


def least_squares_level(open_: np.ndarray, size: int) -> int:
    """The fill level (0: a new sequence) where a piece of ``size`` ids leaves the least sum of
    squared counts; ``open_[l]`` sequences are filled to level l, ``open_[0]`` and the entry of
    a full sequence are 0. Ties go to the fullest."""
    room = len(open_) - 1 - size
    before, after = open_[: room + 1], open_[size:]
    change = 2 * (after - before) + 2  # one less at a level, one more at another
    change[0] = 2 * after[0] + 1
    change[room] -= 1  # a sequence that gets full no longer counts
    change[1:][before[1:] == 0] = np.iinfo(np.int64).max
    return room - int(np.argmin(change[::-1]))


class Packer:
    """Places pieces in sequences; ``done`` holds (sequence number, its pieces)."""

    def __init__(self, width: int = WIDTH, most_open: int = MOST_OPEN):
        self.width, self.most_open = width, most_open
        self.levels = np.zeros(width + 1, dtype=np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(width + 1)]  # open sequences by level
        self.n_open = 0
        self.done: list[list[Piece]] = []

    def _place(self, piece: Piece, level: int) -> None:
        if level:
            sequence = self.at[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            sequence = []
        sequence.append(piece)
        level += len(piece)
        if level == self.width:
            self.done.append(sequence)
        else:
            self.at[level].append(sequence)
            self.levels[level] += 1
            self.n_open += 1

    def add(self, doc: Document, ids: bytes) -> None:
        piece = Piece(doc, 0, memoryview(ids))
        while len(piece) > self.width:
            full, piece = piece.cut(self.width)
            self.done.append([full])
        while self.n_open >= self.most_open:
            top = int(np.flatnonzero(self.levels)[-1])
            if len(piece) <= self.width - top:
                self._place(piece, top)
                return
            head, piece = piece.cut(self.width - top)
            self._place(head, top)
        self._place(piece, least_squares_level(self.levels, len(piece)))

    def finish(self) -> None:
        """Completes the fullest open sequences from the emptiest; the last one is cut into
        powers of two."""
        rest = [s for level in self.at for s in level]  # by fill
        self.at, self.n_open = [[] for _ in self.at], 0
        self.levels[:] = 0
        fill = [sum(map(len, s)) for s in rest]
        low, high = 0, len(rest) - 1
        while low < high:
            need = self.width - fill[high]
            piece = rest[low].pop()
            if len(piece) > need:
                head, piece = piece.cut(len(piece) - need)
                rest[low].append(head)
            rest[high].append(piece)
            fill[low] -= len(piece)
            fill[high] += len(piece)
            if fill[high] == self.width:
                self.done.append(rest[high])
                high -= 1
            if not rest[low]:
                low += 1
        if low == high:
            self._powers(rest[low], fill[low])

    def _powers(self, pieces: list[Piece], total: int) -> None:
        pieces = pieces[::-1]
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            sequence = []
            while size:
                piece = pieces.pop()
                if len(piece) > size:
                    piece, later = piece.cut(size)
                    pieces.append(later)
                sequence.append(piece)
                size -= len(piece)
            self.done.append(sequence)


def _rows(sequences: list[list[Piece]], first: int, id_type: pa.DataType) -> pa.RecordBatch:
    flat = [(first + n, p) for n, s in enumerate(sequences) for p in s]
    offsets = [o for s in sequences for o in np.cumsum([0] + [len(p) for p in s[:-1]]).tolist()]
    cols = {
        "id": pa.array([p.doc.id for _, p in flat], id_type), "start": pa.array([p.start for _, p in flat], pa.int64()),
        "length": pa.array([len(p) for _, p in flat], pa.int64()), "ids": pa.array([bytes(p.ids) for _, p in flat], pa.binary()),
        "doc_tokens": pa.array([p.doc.tokens for _, p in flat], pa.int64()), "sequence_id": pa.array([n for n, _ in flat], pa.int64()),
        "offset": pa.array(offsets, pa.int64())}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _pack(spec, end: bytes, width: int, most_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(spec.value), Packer(width, most_open)
        sequence, id_type = TaskContext.get().partitionId() << 33, None

        def flush(least: int):
            nonlocal sequence
            while len(packer.done) > least:
                # a sequence holds at most ``width`` ids, so a run of rows is bounded
                some, packer.done = packer.done[:run_length], packer.done[run_length:]
                yield _rows(some, sequence, id_type)
                sequence += len(some)

        run_length = max(1, min(FLUSH_ROWS, FLUSH_BYTES // (width * _ID_BYTES)))
        for batch in batches:
            id_type = batch.schema.field("id").type
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                packer.add(Document(id_, len(ids) // _ID_BYTES), ids)
                if len(packer.done) > run_length:
                    yield from flush(run_length - 1)
        packer.finish()
        yield from flush(0)

    return run


def pack(docs: DataFrame, tokenizer_json: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, most_open: int = MOST_OPEN) -> DataFrame:
    """One row per piece: id, start (ids of its document before it), length, ids (binary:
    little-endian unsigned 32-bit token ids), doc_tokens (ids of its document, ``end_id``
    included), sequence_id, offset (place in its sequence, gapless from 0).

    Token ids are those of the tokenizer whose file content is ``tokenizer_json``, without
    added special tokens, special strings inside a text as the library's default has them;
    then ``end_id``. Every id of every row lies in exactly one piece. A sequence has ``width``
    ids or as many as a power of two. Null and empty texts are the end id alone; repeated rows
    and null ids are documents of their own; an empty table has no pieces. Extra columns are
    not read. Sequence numbers depend on how the rows are dealt to tasks."""
    if width < 1:
        raise ValueError("width must be at least 1")
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = lambda *cs: [T.StructField(c, T.LongType()) for c in cs]
    schema = T.StructType([
        T.StructField("id", d.schema["id"].dataType), *long("start", "length"), T.StructField("ids", T.BinaryType()),
        *long("doc_tokens", "sequence_id", "offset")])
    end = np.array([end_id], dtype="<u4").tobytes()
    return d.mapInArrow(_pack(spec, end, width, most_open), schema).withColumnRenamed("id", id_col)


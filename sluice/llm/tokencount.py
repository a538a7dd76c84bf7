"""Token counts without token ids: pieces per distinct pre-token, joined to the per-document
pre-token frequencies and summed.

1. Pre-tokens that ``HOT`` times or more stand in a seeded sample of about ``seed_bytes`` of
   text are hot: they would put many rows under one key of the join. Their piece counts are
   broadcast (at most one entry for HOT pre-tokens of the sample, whatever the corpus).
2. One pass over all documents splits each text into pre-tokens and counts them per
   document. Frequencies of hot pre-tokens are summed in place; every other (document,
   pre-token, frequency) is kept.
3. These pre-tokens are made distinct, each is split into pieces once, the counts join back to
   the frequencies, and the products are summed by document.

Splitting follows the tokenizer's own rule. Where this process's Unicode tables and the
tokenizer's disagree about a character (found by probing both once), texts holding such a
character are split by the tokenizer itself.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import pin

SEED_BYTES = 32 << 20
HOT = 4
CACHE = 400_000
_LONG = 1 << 15

#: Fixed value: the split rule of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pieces:
    """The tokenizer of one vocabulary file, split into its two halves: pre-tokens of a text,
    and the number of pieces of one pre-token. Built from the file's JSON text."""

    def __init__(self, spec: str, odd: frozenset[int] = frozenset()):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.own = Tokenizer.from_str(spec)
        self.specials = [t["content"] for t in json.loads(spec)["added_tokens"]]
        # the same model without splitting: one pre-token in, its pieces out
        data = json.loads(spec) | {"added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(data))
        self.bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(SPLIT).findall
        self.loose_space = regex.compile(r"\s \s?| \s|^ | \Z").search
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.odd = frozenset(map(chr, odd))

    def counts(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.bare.encode_batch(pretokens, add_special_tokens=False)]

    def is_odd(self, text: str) -> bool:
        return not text.isascii() and not self.odd.isdisjoint(text)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if self.is_odd(text):
            return [text[a:b] for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def units(self, text: str) -> list[str]:
        """Cuts a text at its single spaces. Each unit (its leading space included) splits
        into pre-tokens on its own, so repeated units need splitting once."""
        if self.loose_space(text) or self.is_odd(text):
            return [text] if text else []
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + r for r in rest]


@lru_cache(maxsize=4)
def pieces_of(spec: str, odd: frozenset[int] = frozenset()) -> Pieces:
    """Built once per Python worker: reading a vocabulary takes about a second."""
    return Pieces(spec, odd)


def probe(spec: str) -> frozenset[int]:
    """Code points that the tokenizer's split rule and this process's treat differently, of
    all but the surrogates. In a block split once only, what stands with the a are letters
    and what stands with the dot is no letter, digit or space, so both agree on all of it;
    of the other blocks every character is tried."""
    p, out = Pieces(spec), []
    own = lambda text: [text[a:b] for _, (a, b) in p.own.pre_tokenizer.pre_tokenize_str(text)]
    for first in (*range(0, 0xD800, 256), *range(0xE000, 0x110000, 256)):
        block = "".join(map(chr, range(first, first + 256)))
        found = p.find(f"a{block}.")
        if len(found) == 2 and own(f"a{block}.") == found:
            continue
        for c in block:
            text = f"a{c}a 1{c}1 .{c}."
            if own(text) != p.find(text):
                out.append(ord(c))
    return frozenset(out)


@lru_cache(maxsize=4)
def _probed(spec: str) -> frozenset[int]:
    return probe(spec)


def _occurrences(spec):
    """(pretoken, n): the distinct pre-tokens of a task's texts with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total = pieces_of(*spec.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in p.special.split(text) if p.special else [text]:
                    for unit, n in Counter(p.units(part)).items():
                        for w in p.split(unit):
                            total[w] += n
        names = list(total)
        for i in range(0, len(names), 20_000):
            some = names[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([total[w] for w in some], pa.int64())], ["pretoken", "n"])

    return run


def _frequencies(spec, known, schema_names: list[str]):
    """Per row: bytes, specials, summed pieces of known pre-tokens, and the rest as a list
    of (pretoken, freq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, pieces = pieces_of(*spec.value), known.value
        memo: dict[str, tuple[int, tuple[str, ...]]] = {}
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                done, names, freqs, cut = [], [], [], [0]
                for text in part.column(at).to_pylist():
                    found, rest = 0, Counter()
                    bits = p.special.split(text or "") if p.special else [text or ""]
                    found += len(bits) - 1
                    for bit in bits:
                        for unit, n in Counter(p.units(bit)).items():
                            have = memo.get(unit)
                            if have is None:
                                words = p.split(unit)
                                have = (sum(pieces.get(w, 0) for w in words), tuple(w for w in words if w not in pieces))
                                if len(unit) < 64 and len(memo) < CACHE:
                                    memo[unit] = have
                            found += n * have[0]
                            for w in have[1]:
                                rest[w] += n
                    done.append(found)
                    names += rest.keys()
                    freqs += rest.values()
                    cut.append(len(names))
                pair = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(freqs, pa.int64())], ["pretoken", "freq"])
                new = {"known": pa.array(done, pa.int64()), "rest": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pair)}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(part.schema.get_field_index(c)) for c in schema_names], schema_names)

    return run


def _count_pieces(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(*spec.value)
        for batch in batches:
            names = batch.column(0)
            for first in range(0, len(names), 2_000):
                part = names.slice(first, 2_000)
                yield pa.RecordBatch.from_arrays([part, pa.array(p.counts(part.to_pylist()), pa.int64())], ["pretoken", "pieces"])

    return run


def token_counts(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", seed_bytes: int = SEED_BYTES, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens as the tokenizer of
    ``tokenizer_json`` (the content of its file) counts them without added special tokens.

    Null counts as empty: 0 bytes, 0 tokens. Special strings inside a text are one token
    each, as the library's default has it. Repeated rows and null ids each keep their row:
    frequencies are keyed by a number that each row gets when the frequencies are written.
    Extra columns are not read."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast((tokenizer_json, _probed(tokenizer_json)))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, seed_bytes / size) if size else 1.0
    span = 1 << 20
    sample = d.where(F.pmod(F.xxhash64("text"), F.lit(span)) < int(share * span)).where(F.length("text") <= _LONG).select("text")
    seen = sample.mapInArrow(_occurrences(spec), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    seeds = seen.where(F.col("n") >= hot).select("pretoken")
    # bounded by the sample: one pre-token for every ``hot`` of its occurrences
    rows = seeds.mapInArrow(_count_pieces(spec), "pretoken string, pieces long").toLocalIterator()
    known = spark.sparkContext.broadcast({r.pretoken: r.pieces for r in rows})
    pair = T.StructType([T.StructField("pretoken", T.StringType()), T.StructField("freq", T.LongType())])
    schema = T.StructType([
        T.StructField("id", d.schema["id"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("known", T.LongType()), T.StructField("rest", T.ArrayType(pair))])
    found = d.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(_frequencies(spec, known, schema.names), schema)
    # the row numbers are written with the frequencies, so every later read has the same
    per_doc = pin(found.withColumn("row", F.monotonically_increasing_id()), "pretokens")
    freq = per_doc.select("row", F.explode("rest").alias("x")).select("row", "x.pretoken", "x.freq")
    pieces = freq.select("pretoken").distinct().mapInArrow(_count_pieces(spec), "pretoken string, pieces long")
    per = freq.join(pieces, "pretoken").groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("more"))
    out = per_doc.select("id", "n_bytes", "known", "row").join(per, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))

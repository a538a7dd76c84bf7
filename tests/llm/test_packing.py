from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import packing as PK
from sluice.llm.queries import op11_packing

from .conftest import ODD_TEXTS

PATH = P.path("byte_bpe_50k.json")


def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def strange_texts():
    rng = random.Random(4)
    alphabet = list("abc  \n\n\t.,'!?0123é漢😀  \u0085\x1c՘₏\U00010940\U000323b0") + ["'s", "'ll", " the", "  ", "<|endoftext|>", "\r\n"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return out + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "q" * 3000, ".,'" * 2000, " " * 3000 + "x", "\U0010fffd's"] + ODD_TEXTS


def ids_of(piece):
    return np.frombuffer(piece.ids, dtype="<u4").tolist()


def check(pieces, texts, width):
    """Every document's ids lie in exactly one piece each; sequences are gapless and full or
    as long as a power of two. ``texts``: list of texts, keyed by position as doc_id."""
    tok = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text in enumerate(texts):
        want = tok.encode(text or "", add_special_tokens=False).ids + [0]
        got, at = [], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.length, p.doc_tokens) == (at, len(ids_of(p)), len(want)) and p.length > 0
            got += ids_of(p)
            at += p.length
        assert got == want, (i, text)
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        ends = list(itertools.accumulate(p.length for p in ps))
        assert [p.offset for p in ps] == [0, *ends[:-1]]
        assert ends[-1] <= width and (ends[-1] == width or ends[-1] & (ends[-1] - 1) == 0)
    return by_sequence


@pytest.mark.parametrize(("width", "most_open"), [(1024, 512), (16, 3), (7, 1), (1, 1)])
def test_pieces_hold_every_id_once(docs, width, most_open):
    texts = strange_texts() if width > 1 else ["a b c", None, "x"]
    out = PK.pack(docs(list(enumerate(texts))), spec(), width=width, most_open=most_open).collect()
    check(out, texts, width)


def test_long_texts_go_in_stretches(docs, monkeypatch):
    texts = ["word " * 30_000, "no" * 20_000, "a  b\n " * 9_000, "漢字" * 3_000 + " end"]
    monkeypatch.setattr(PK, "STRETCH", 1000)  # in this process; workers keep theirs
    tok, encoder = Tokenizer.from_file(PATH), PK.Encoder(spec())
    assert max(len(list(encoder._stretches(t))) for t in texts) > 10
    for t in texts:
        assert np.frombuffer(encoder.ids(t), dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    check(PK.pack(docs(list(enumerate(texts))), spec()).collect(), texts, 1024)


def test_fast_library_takes_settled_characters_only():
    encoder = PK.Encoder(spec())
    assert encoder.fast is not None
    assert not encoder.settled & set("\u0085\x1c᠎\U000323b0​")
    assert set("aé漢ß\n 0.") <= encoder.settled
    other = spec().replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true')
    assert PK.Encoder(other).fast is None


def test_both_libraries_agree_on_settled_characters():
    encoder, rng = PK.Encoder(spec()), random.Random(3)
    chars = sorted(encoder.settled)
    for _ in range(300):
        text = "".join(rng.choice(chars if rng.random() < 0.5 else " a1.'\n") for _ in range(60))
        assert encoder.fast.encode_ordinary(text) == encoder.own.encode(text, add_special_tokens=False).ids, text


def test_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(500):
        width = int(rng.integers(2, 12))
        open_ = np.append(0, np.append(rng.integers(0, 4, width - 1), 0))
        size = int(rng.integers(1, width + 1))

        def after(level):
            n = open_.copy()
            if level:
                n[level] -= 1
            if level + size < width:
                n[level + size] += 1
            return int((n**2).sum())

        options = [lv for lv in range(width - size + 1) if lv == 0 or open_[lv]]
        best = min(map(after, options))
        assert PK.least_squares_level(open_.copy(), size) == max(lv for lv in options if after(lv) == best)


def test_open_sequences_are_bounded():
    packer = PK.Packer(width=100, most_open=5)
    for i in range(500):  # no two of them fit one sequence
        packer.add(PK.Document(i, 60), b"\1\0\0\0" * 60)
        assert packer.n_open <= 5 and packer.n_open == sum(map(len, packer.at)) == packer.levels.sum()
    packer.finish()
    assert sum(len(p) for s in packer.done for p in s) == 500 * 60
    assert sum(1 for s in packer.done if sum(map(len, s)) < 100) <= 7


def test_few_documents_are_cut():
    rng, packer = random.Random(2), PK.Packer()
    n = 20_000
    for i in range(n):
        size = rng.randint(1, 700)
        packer.add(PK.Document(i, size), b"\1\0\0\0" * size)
    packer.finish()
    assert sum(map(len, packer.done)) < 1.06 * n


def test_odd_tables(docs):
    assert PK.pack(docs([]), spec()).count() == 0
    schema = "doc_id string, text string, id string, ids string, start int, sequence_id int, length int, offset int"
    rows = [(None, "a b", "x", "y", 1, 2, 3, 4), (None, "a b", "x", "y", 1, 2, 3, 4), ("k", None, None, None, None, None, None, None)]
    out = PK.pack(docs(rows, schema), spec()).collect()
    tok = Tokenizer.from_file(PATH)
    assert sum(p.length for p in out) == 2 * (len(tok.encode("a b").ids) + 1) + 1
    assert {p.doc_id for p in out} == {None, "k"}
    with pytest.raises(ValueError, match="width"):
        PK.pack(docs([(1, "a")]), spec(), width=0)


def test_sequences_of_different_tasks_differ_and_digest(spark, docs):
    texts = [f"text number {i} " * (i % 50) for i in range(300)]
    out = PK.pack(docs(list(enumerate(texts))), spec())
    rows = out.withColumn("crc", F.crc32("ids")).collect()
    check(rows, texts, 1024)
    import zlib

    assert all(r.crc == zlib.crc32(r.ids) for r in rows)
    digest = op11_packing(spark, "/root/testdata/sf0.001")
    assert digest.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [t for _, t in digest.dtypes[1:]] == ["bigint"] * 6

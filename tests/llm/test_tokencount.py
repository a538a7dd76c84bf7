from __future__ import annotations

import random

import public_tokenizers as P
from tokenizers import Tokenizer

from sluice.llm import tokencount as TC

from .conftest import ODD_TEXTS

PATH = P.path("byte_bpe_50k.json")


def spec():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def texts():
    rng = random.Random(2)
    alphabet = list("abc  \n\n\t.,'!?0123é漢😀  \u0085\x1c՘₏\U00010940") + ["'s", "'ll", " the", "  ", "<|endoftext|>", "\r\n"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out += ["it's we'll  two   spaces\n\n x", " lead", "trail ", "\n x", "x \n y", "<|endoftext|>", "a<|endoftext|> b", "<|endoftext", "q" * 5000]
    return out + ODD_TEXTS


def test_counts_equal_the_library(docs):
    tok = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts()))
    for seed_bytes in (TC.SEED_BYTES, 4_000, 0):  # 0: every pre-token goes through the join
        out = {r.doc_id: r for r in TC.token_counts(docs(rows), spec(), seed_bytes=seed_bytes).collect()}
        assert len(out) == len(rows)
        for i, t in rows:
            want = len(tok.encode(t or "", add_special_tokens=False).ids)
            assert (out[i].n_tokens, out[i].n_bytes) == (want, len((t or "").encode())), (i, t)


def test_repeats_nulls_and_empty(docs):
    tok = Tokenizer.from_file(PATH)
    rows = [(1, "qzxv zzq"), (1, "qzxv zzq"), (1, "other"), (None, "qq zz"), (None, "qq zz"), (2, None)]
    out = sorted((str(r.doc_id), r.n_tokens) for r in TC.token_counts(docs(rows), spec(), seed_bytes=0).collect())
    assert out == sorted((str(i), len(tok.encode(t or "").ids)) for i, t in rows)
    assert TC.token_counts(docs([]), spec()).count() == 0


def test_characters_of_the_high_planes(docs):
    tok = Tokenizer.from_file(PATH)
    rows = list(enumerate(f"it{c}'s 1{c}2 {c}{c} .{c}!" for c in "\U0002fa1d\U000323b0\U00033479\U00040000\U000e01ef\U000f0000\U0010fffd"))
    rows.append((len(rows), "\U000323b0's"))
    out = {r.doc_id: r.n_tokens for r in TC.token_counts(docs(rows), spec(), seed_bytes=0).collect()}
    assert out == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_probe_finds_every_character_split_differently():
    p, odd = TC.Pieces(spec()), TC.probe(spec())
    rng = random.Random(6)
    cps = [*range(0x32300, 0x32400), *rng.sample(range(0xE000, 0x110000), 5000), *sorted(odd)[::50]]
    for cp in cps:
        text = f"a{chr(cp)}a 1{chr(cp)}1 .{chr(cp)}."
        same = [text[a:b] for _, (a, b) in p.own.pre_tokenizer.pre_tokenize_str(text)] == p.find(text)
        assert same == (cp not in odd), hex(cp)


def test_hot_pretokens_change_no_count(docs):
    rows = [(i, "the same words and " * (i % 7) + f"x{i} y{i % 3}") for i in range(60)]
    count = lambda **kw: sorted((r.doc_id, r.n_tokens) for r in TC.token_counts(docs(rows), spec(), **kw).collect())
    tok = Tokenizer.from_file(PATH)
    want = [(i, len(tok.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    assert count() == count(hot=1) == count(hot=10**9) == count(seed_bytes=500) == want

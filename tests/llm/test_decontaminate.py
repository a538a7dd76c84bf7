from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import decontaminate as DC
from sluice.llm.text import ALNUM, Buffer, Words, shingles

from .conftest import ODD_TEXTS, by_id

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(window, len(v))
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1) if wins else []:
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [a + b for a in "abcde" for b in "xyz"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 13, 14, 40])))) for i in range(20)]
    items += [(20, ""), (21, None), (22, "!!!"), (23, items[0][1]), (24, "Ärger IST das")]
    rows = []
    for i in range(n):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            src = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(src) - 13))
            at = rng.randint(0, len(body))
            body[at:at] = src[a : a + 20]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in body)))
    return rows + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_against_brute_force(spark, docs, block_bytes):
    rows, items = corpus(1)
    out = by_id(DC.contamination(docs(rows), docs(items, "item_id long, text string"), block_bytes=block_bytes))
    assert len(out) == len(rows)
    for i, t in rows:
        n, hit, found = brute(t, items)
        r = out[i]
        assert (r.n_words, r.n_hit, list(r["items"]), r.n_items) == (n, hit, found, len(found)), (i, t)


def test_empty_tables_and_repeats(spark, docs):
    none = docs([], "item_id long, text string")
    out = by_id(DC.contamination(docs([(1, "a b c"), (2, None)]), none))
    assert [(out[i].n_words, out[i].n_hit) for i in (1, 2)] == [(3, 0), (0, 0)]
    assert DC.contamination(docs([]), docs([(1, "a b")], "item_id long, text string")).count() == 0
    twice = DC.contamination(docs([(1, "x a b"), (1, "x a b"), (1, "z")]), docs([(7, "A B")], "item_id long, text string")).collect()
    assert sorted((r.n_words, r.n_hit) for r in twice) == [(1, 0), (3, 2), (3, 2)]


def test_decontaminate_keeps_columns_with_clashing_names(spark):
    rows = [(1, "a b c d", 9, "s", 1), (2, "q r", 8, None, 2), (None, None, 7, "t", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words long, items string, `my id` int")
    b = spark.createDataFrame([(5, "a b c d", "u")], "item_id long, text string, doc_id string")
    out = DC.decontaminate(d, b)
    assert out.schema.names == d.schema.names
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(rows[1:], key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_buffer_words_match_regex(texts):
    got = Words(Buffer([t.encode() for t in texts]), ALNUM)
    want = [words(t) for t in texts]
    assert got.counts().tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(got.hash.tolist())) == len(set(flat))
    docs, hashes = shingles(got, 3)
    for i, w in enumerate(want):
        expect = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
        assert len(set(hashes[docs == i].tolist())) == len(expect)
    assert isinstance(hashes, np.ndarray)

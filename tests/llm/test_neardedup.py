from __future__ import annotations

import random
import re

import numpy as np
import pytest

from sluice.llm import neardedup as ND
from sluice.llm.components import components

from .conftest import ODD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    """Groups of near copies around a base that itself may be missing, whose members are
    linked to one another only here and there, besides short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = []
    for size, edits, keep in ((60, 6, True), (200, 9, False), (30, 2, True), (120, 4, False)):
        base = [word() for _ in range(size)]
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
        if keep:
            texts += [" ".join(base)] * 3
    passage = [word() for _ in range(80)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(5, 60))]) for _ in range(60)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(20)] + ["a b", "A  B", "a b c", "a b c d"]
    rng.shuffle(texts)
    return list(enumerate(texts + ODD_TEXTS))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(docs, k, percent):
    rows = corpus(k)
    out = {r.doc_id: r for r in ND.near_groups(docs(rows), shingle=k, percent=percent).collect()}
    want = brute(rows, k, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in out.items())


def test_small_blocks_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(ND, "BLOCK", 3)
    rows = corpus(9)
    out = {r.doc_id: r.component_id for r in ND.near_groups(docs(rows), shingle=3, percent=85).collect()}
    assert out == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def test_repeats_nulls_and_empty(docs, spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d"), (3, None), (4, ""), (1, "quite other words here")]
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in ND.near_groups(docs(rows)).collect())
    assert out == sorted([("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("None", 1, "None", True), ("3", 0, "3", True), ("4", 0, "4", True), ("1", 1, "1", True)])
    assert ND.near_groups(docs([])).count() == 0
    d = spark.createDataFrame([(1, "x y", 5), (1, "x y", 4), (2, "x y", 3), (3, None, 2)], "doc_id long, text string, c int")
    kept = ND.drop_near_copies(d)
    assert kept.schema.names == d.schema.names
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "x y"), (3, None)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (1, 2, 10, 300, 3000):
        common = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.2, 1.0):
            a = np.concatenate((common, rng.integers(0, 2**63, int(n * share), dtype=np.uint64)))
            x, y = ND.sketch(common), ND.sketch(a)
            assert (x < np.iinfo(np.int64).max).all()
            assert (ND.sketch(rng.permutation(a)) == y).all()
            errors.append((x == y).mean() - n / len(a))
    assert max(map(abs, errors)) < 0.15
    for p in (0.8, 0.85, 0.95):
        bands, rows = ND.banding(p)
        assert bands * rows <= ND.SIZE
        assert (1 - p**rows) ** bands < ND.MISS


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (300, 301), (301, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in components(df).collect()}
    groups = {}
    for n, r in roots.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 150)), [300, 301]]


def test_one_row_of_a_component_stays_for_null_and_repeated_ids(docs):
    base = [f"w{i}" for i in range(60)]
    near = lambda at: " ".join([*base[:at], "zz", *base[at + 1 :]])
    other = "quite other words that nobody else has here"
    rows = [(None, near(0)), (None, near(59)), (None, " ".join(base)), (None, "one two three four five six"), (None, "One two three four five six")]
    out = ND.drop_near_copies(docs(rows)).collect()
    assert len(out) == 2 and {"zz" in r.text or "w5" in r.text for r in out} == {True, False}
    rows += [(7, near(0)), (7, near(59)), (7, other), (8, other.upper()), (9, None), (None, ""), (None, "")]
    for _ in range(2):
        out = [(r.doc_id, r.text) for r in ND.drop_near_copies(docs(rows)).collect()]
        assert sorted(i for i, t in out if t and i is not None) == [7, 7]
        assert sum(t in (near(0), near(59)) for _, t in out) == 1 and (7, other) in out
        assert sorted(((i, t) for i, t in out if i != 7), key=str) in (
            sorted([(None, t), (9, None), (None, "")], key=str) for t in ("one two three four five six", "One two three four five six"))
        rows = rows[::-1]

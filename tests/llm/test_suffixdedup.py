from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from sluice.llm import suffixdedup as SD
from sluice.llm.queries import op6_suffix_dedup

from .conftest import ODD_TEXTS


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in data:
        for x in range(len(b) - length + 1):
            seen[b[x : x + length]] = seen.get(b[x : x + length], 0) + 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for x in range(len(b) - length + 1):
            if seen[b[x : x + length]] > 1:
                gone[x : x + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    alphabet = "abcdefghij éß漢"
    rand = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [rand(n) for n in (60, 99, 100, 101, 150, 400)] + ["ab" * 90, "x" * 230]
    texts = []
    for _ in range(70):
        t = "".join(rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.5 else rand(rng.randint(0, 80)) for _ in range(rng.randint(0, 6)))
        texts.append(t)
    texts += [texts[3], texts[3] + "z", "y" * 101, "q" * 100]
    return list(enumerate([*texts, *[t for t in ODD_TEXTS if not t or len(t) < 1000], "word " * 100]))


@pytest.mark.parametrize("kw", [{}, {"shard_bytes": 500, "bucket_bytes": 4000}, {"group": 2}])
def test_against_brute_force(docs, kw):
    rows = corpus(3)
    assert result(SD.drop_repeats(docs(rows), length=100, **kw)) == brute(rows, 100)


def test_repeats_nulls_and_empty(docs, spark):
    rng = random.Random(8)
    t = "".join(rng.choice("abcd") for _ in range(130))
    rows = [(1, t), (1, t), (2, "u" + t[:100]), (None, t + "v"), (3, None)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, h int, spans int")
    assert result(SD.drop_repeats(d, length=100)) == brute(rows, 100)
    assert SD.drop_repeats(docs([])).count() == 0


def test_query_takes_400_bytes_however_many_words(docs, tmp_path, spark):
    """A shared passage of over 50 words stays while it has 399 bytes and goes with 400."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    short, long = words(60)[:399], words(60)[:400]
    assert min(len(short.split()), len(long.split())) > 50
    texts = [f"{words(20)}{mark}{passage}{mark.upper()}{words(20)}" for mark, passage in (("w", short), ("x", short), ("y", long), ("z", long))]
    rows = list(enumerate(texts))
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op6_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed for i in range(4)] == [0, 0, 400, 400]
    assert sorted((str(i), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()) == [r[:-1] for r in brute(rows, 400)]
    assert [got[i].kept_text for i in (0, 2)] == [texts[0], texts[2].replace(long, "")]


def test_merge_keeps_shard_orders_and_sorts():
    """The interleave from the transforms alone equals a sort of all suffixes by their symbols."""
    rng = random.Random(2)
    step, rounds = 4, 3
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    c = SD.Collection(texts, step, rounds)
    half = c.piece < 15
    a, b = c.order(np.flatnonzero(half), rounds), c.order(np.flatnonzero(~half), rounds)
    empty = lambda o: int((c.sym[o] == 0).sum())
    z, interval = SD.merge(c.bwt[a], c.bwt[b], empty(a), empty(b), rounds)
    merged = np.empty(len(z), dtype=np.int64)
    merged[~z], merged[z] = a, b

    def symbols(pos):
        out = []
        while pos >= 0 and c.sym[pos] and len(out) < rounds:
            out.append(int(c.sym[pos]))
            pos = int(c.next[pos])
        return out

    keys = [symbols(p) for p in merged]
    assert len(keys) > 100 and sorted(merged.tolist()) == list(range(len(c.x)))
    assert keys == sorted(keys)
    for i in range(1, len(keys)):
        if len(keys[i]) == rounds:
            assert (interval[i] == interval[i - 1]) == (keys[i] == keys[i - 1])


def test_long_texts_in_stretches(docs, monkeypatch):
    rng = random.Random(5)
    t = "".join(rng.choice("abcdef") for _ in range(900))
    rows = [(1, t + t[200:500]), (2, "k" + t[:350])]
    want = SD.pieces(rows[0][1].encode(), 100)
    monkeypatch.setattr(SD, "_STRETCH", 64)
    parts = SD.pieces(rows[0][1].encode(), 100)
    assert sum(int(p[3].sum()) for p in parts) == sum(int(p[3].sum()) for p in want) == len(rows[0][1]) - 99

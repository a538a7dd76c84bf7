from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import hardnegatives as HN

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ["anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score"]


def usable(row, dims):
    i, v, label = row[:3]
    return i is not None and label is not None and v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, dims, anchor=lambda i: i % 10 == 0, n=5):
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in (r[:3] for r in rows if usable(r, dims))]
    out = []
    for i, v, label in {(i, tuple(v), label) for i, v, label in rows if anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, w, other in rows if j != i)
        found = [(j, -s) for s, j, other in scored if other == label][:n]
        for k, (j, p) in enumerate(found):
            hard = [(g, -s) for s, g, other in scored if other != label and 80 * p <= -100 * s <= 100 * p][:n]
            out += [(i, j, k + 1, r + 1, g, p, s) for r, (g, s) in enumerate(hard)]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def vectors(n, dims, seed, labels=3, scale=0.5):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0.1, scale) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]
    for i in range(n // 4):  # ties: copies and near copies under other ids
        out.append((n + i, list(out[rng.randrange(n)][1]), rng.randrange(labels)))
    return out


def test_equals_brute_force(spark):
    for seed, scale in ((1, 0.5), (2, 0.01), (3, 300.0)):
        rows = vectors(300, 8, seed, scale=scale)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = result(HN.mine(df, F.col("vec_id") % 10 == 0))
        assert got == brute(rows, 8) and got


def test_blocks_change_nothing(spark, monkeypatch):
    rows = vectors(200, 5, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(HN.mine(df, F.col("vec_id") % 10 == 0, anchor_block=4)) == brute(rows, 5)
    # candidates in many blocks, in this process
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in rows])
    a = HN.Anchors([(r[0], r[2], list(map(int, v))) for r, v in zip(rows[:9], x, strict=False)])
    for size in (1, 7, 64):
        for at in range(0, len(x), size):
            packed = HN.Packed(x[at : at + size], a.top)
            for k in range(9):
                assert (packed.scores(a.x[k], a.low, a.sums[k]) == x[at : at + size] @ x[k]).all()


def test_wide_fields_and_the_bound(spark):
    rows = [(0, [6e5, -6e5], 1), (1, [6e5, 1.0], 1), (2, [5e5, 3.0], 2), (3, [1e30, 5.0], 2), (10, [-1e30, 1e30], 1)]
    limit = (1 << 30) - 1  # (62 - 2 bits) / 2
    cut = lambda c: max(-limit, min(limit, math.floor(256 * float(np.float32(c)))))
    got = {(r.anchor_id, r.positive_id, r.negative_id, r.positive_score, r.negative_score) for r in HN.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()}
    score = lambda a, b: sum(cut(x) * cut(y) for x, y in zip(a, b, strict=True))
    p = {i: score(rows[0][1], v) for i, v, _ in rows}
    assert got == {(0, j, g, p[j], p[g]) for j in (1, 10) for g in (2, 3) if 80 * p[j] <= 100 * p[g] <= 100 * p[j]}


def test_odd_rows(spark):
    nan = float("nan")
    good = vectors(60, 4, 6)
    odd = [(None, [1.0] * 4, 1), (70, None, 1), (80, [1.0, None, 1.0, 1.0], 1), (90, [nan] * 4, 1), (110, [1.0] * 4, None), (120, [1.0], 1), (130, [], 2)]
    twice = [good[10], good[10], (10, good[3][1], good[3][2]), good[7], good[7]]
    rows = good + odd + twice
    schema = SCHEMA + ", id int, x int, v int, is_anchor int, anchor int, score int, rank int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], schema).repartition(4)
    assert result(HN.mine(df, F.col("vec_id") % 10 == 0)) == brute(rows, 4)


def test_empty_and_lonely(spark):
    none = HN.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0)
    assert none.count() == 0 and none.columns == NAMES
    lonely = spark.createDataFrame([(100, [1.0, 0.5], 1), (1, [1.0, 0.5], 2), (2, [1.0, 0.25], 3)], SCHEMA)
    assert HN.mine(lonely, F.col("vec_id") % 100 == 0).count() == 0  # no positive
    zero = spark.createDataFrame([(100, [0.0], 1), (1, [1.0], 1), (2, [1.0], 2), (3, [-1.0], 2)], SCHEMA)
    assert result(HN.mine(zero, F.col("vec_id") % 100 == 0)) == [(100, 1, 1, 1, 2, 0, 0), (100, 1, 1, 2, 3, 0, 0)]
    below = spark.createDataFrame([(100, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)], SCHEMA)
    assert HN.mine(below, F.col("vec_id") % 100 == 0).count() == 0  # negative positives have no room

from __future__ import annotations

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import whitening as WH
from sluice.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>"


def whole_numbers(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def brute(rows, wanted=4):
    """Plain whitening of [(id, vector)] of one length, in whole numbers until eigh."""
    x = [whole_numbers(v) for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, dims = len(fit), len(fit[0])
    s = [sum(v[d] for v in fit) for d in range(dims)]
    cov = np.array([[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit) / n**3 for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:wanted]
    mean = np.array(s) / n
    out = {}
    for (i, _), v in zip(rows, x, strict=True):
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))
        out[i] = (n, deviation, [float((np.array(v) - mean) @ vectors[:, k] / math.sqrt(values[k])) for k in order], [values[k] / np.trace(cov) for k in order])
    return out


def vectors(n, dims, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims)) * np.linspace(1, 3, dims) * scale
    return [(i, [float(c) for c in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("scale", [0.3, 1e6, 1e13])
def test_equals_brute_force(spark, scale):
    rows = vectors(150, 6, 1, scale)
    rows += [(1000 + i, v) for i, (_, v) in enumerate(rows[:40])]  # copies are fitted once
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = WH.whiten(df).collect()
    want = brute(rows)
    assert len(out) == 4 * len(rows)
    sign = {}
    for r in sorted(out, key=lambda r: (r.vec_id, r.component)):
        n, deviation, z, share = want[r.vec_id]
        k = r.component - 1
        sign.setdefault(k, math.copysign(1, r.whitened) * math.copysign(1, z[k]))
        assert r.n == n and r.deviation == Decimal(deviation)
        assert abs(r.whitened - sign[k] * z[k]) < 1e-8 * max(1, abs(z[k]))
        assert abs(r.explained / share[k] - 1) < 1e-8 and r.identity_error < 1e-8


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 130), st.integers(1, 5), st.integers(0, 60), st.integers(0, 10**6))
def test_cross_products_are_exact(rows, dims, bits, seed):
    rng = random.Random(seed)
    x = np.array([[rng.randint(-(1 << bits), 1 << bits) for _ in range(dims)] for _ in range(rows)], dtype=np.int64)
    sums, both = WH.cross_products(x)
    exact = x.astype(object)
    assert list(sums) == list(exact.sum(axis=0))
    assert (both == exact.T @ exact).all()


def test_left_out_rows_and_flat_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (None, [-1.0, 5.0, 0.0]), (3, [0.5, -1.0, 0.0]), (4, None), (5, [1.0, None, 2.0]),
            (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, []), (9, [1.0, 2.0])]
    out = WH.whiten(spark.createDataFrame(rows, SCHEMA), components=5).collect()
    assert sorted(str(r.vec_id) for r in out) == sorted([*["1"] * 6, *["None"] * 3, *["3"] * 3])  # three dimensions, three components
    assert {r.n for r in out} == {3}
    flat = [r for r in out if r.component == 3]  # nothing varies there
    assert all(r.whitened is None for r in flat) and all(r.whitened is not None for r in out if r.component < 3)
    assert max(r.identity_error for r in out) < 1e-8


def test_one_vector_and_no_vectors(spark):
    out = WH.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out] == [(1, 0, None, None, None)] * 4
    empty = WH.whiten(spark.createDataFrame([(4, None), (5, [])], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_clashing_columns_and_huge_entries(spark):
    schema = "vec_id string, embedding array<double>, id int, x int, v int, k int, whitened int, n int"
    rows = [(str(i), [float(i), float(i * i % 7), 1e300 if i == 3 else 0.0], 1, 2, 3, 4, 5, 6) for i in range(20)]
    out = WH.whiten(spark.createDataFrame(rows, schema), components=2).collect()
    # next to the huge entry all else is rounding
    assert len(out) == 40 and all((r.whitened is not None) == (r.component == 1) and r.n == 20 for r in out)
    assert all(r.deviation is None or r.deviation >= 0 for r in out)


def test_query_columns_and_values(spark):
    out = op12_whitening(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    # covariance in doubles here: 64 x 64 whole-number sums in plain Python take too long
    x = np.array([whole_numbers(v) for _, v in rows])
    fit = np.unique(x, axis=0)
    values, comps = np.linalg.eigh((fit - fit.mean(axis=0)).T @ (fit - fit.mean(axis=0)) / len(fit))
    got = {(r.vec_id, r.component): r for r in out.collect()}
    assert len(got) == 4 * len(rows)
    for c in range(1, 5):
        z = (x - fit.mean(axis=0)) @ comps[:, -c] / np.sqrt(values[-c])
        mine = np.array([got[i, c].whitened for i, _ in rows])
        assert min(abs(z - mine).max(), abs(z + mine).max()) < 1e-8
        assert abs(got[rows[0][0], c].explained / (values[-c] / values.sum()) - 1) < 1e-8
    for (i, _), v in zip(rows, x, strict=True):
        assert got[i, 1].deviation == sum((len(fit) * int(a) - int(b)) ** 2 for a, b in zip(v, fit.sum(axis=0), strict=True))

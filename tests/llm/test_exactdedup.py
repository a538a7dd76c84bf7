from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import exactdedup as ED

from .conftest import ODD_TEXTS

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        key = SPACE.sub("", t or "")
        keep = min(groups[key], key=lambda x: (x[0], x[1] is not None, x[1] or 0))[1]
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def sample():
    rng = random.Random(3)
    base = ["lorem ipsum " * k for k in (1, 5, 900)] + ["Ünï 漢字", "a b c"]
    rows = []
    for i in range(120):
        t = rng.choice(base)
        rows.append((i, "".join(c + (" " if rng.random() < 0.02 else "") for c in t)))
    return rows + [(500 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, rows[3][1]), (None, "a b c")]


def test_against_brute_force(docs):
    rows = sample()
    assert result(ED.exact_groups(docs(rows))) == brute(rows)


def test_small_chunks_and_slices(docs):
    rows = sample()
    assert result(ED.exact_groups(docs(rows), chunk=7, split_chars=50)) == brute(rows)


def test_colliding_fingerprints_are_told_apart(docs, monkeypatch):
    """With fingerprints cut to nothing every text collides; the comparison rounds decide."""
    from pyspark.sql import functions as F

    real = ED.fingerprints
    monkeypatch.setattr(ED, "fingerprints", lambda d, s: real(d, s).withColumns({c: F.lit(0).cast("long") for c in ("m", "f1", "f2")}))
    rows = [(i, t) for i, t in enumerate(["a", "b", "a ", "", None, "cc", "b", "ab", "ac"])]
    assert result(ED.exact_groups(docs(rows))) == brute(rows)


def test_empty_table_and_pipeline_form(docs, spark):
    assert ED.exact_groups(docs([])).count() == 0
    rows = [(1, "a b", "x", 1), (2, "a  b", "y", 2), (2, "a  b", "z", 3), (3, None, None, 4), (4, "", "q", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row string, best int")
    out = ED.drop_copies(d)
    assert out.schema.names == d.schema.names
    assert sorted((r.doc_id, r.row) for r in out.collect()) == [(2, "y"), (3, None)]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=9000), st.binary(max_size=9000))
def test_fingerprints_compose(a, b):
    assert ED.combine(ED.fingerprint(a), ED.fingerprint(b)) == ED.fingerprint(a + b)
    value = 0
    for c in a:
        value = (value * ED.POINTS[0] + c + 1) % ED.PRIME
    assert ED.fingerprint(a)[:2] == (len(a), value)


def test_one_row_stays_where_an_id_repeats_with_other_white_space(docs):
    rows = [(1, "a b"), (1, "ab"), (1, "a b"), (2, "a b"), (None, "x  y"), (None, "xy"), (3, "c d"), (3, "e f"), (4, ""), (4, None), (4, " ")]
    out = [(r.doc_id, r.text) for r in ED.drop_copies(docs(rows)).collect()]
    assert sorted(out, key=str) == sorted([(1, "a b"), (None, "x  y"), (3, "c d"), (3, "e f"), (4, " ")], key=str)
    assert {r.kept for r in ED.exact_groups(docs([(1, "a b"), (1, "ab")])).collect()} == {True}

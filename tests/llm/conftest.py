from __future__ import annotations

import pytest


@pytest.fixture()
def docs(spark):
    """docs(rows, schema=None): a documents-like DataFrame over several partitions."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)

    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


#: Texts that every operator must survive: null, empty, blank, single word, very long,
#: other scripts, control bytes.
ODD_TEXTS = [None, "", " \t\n", "x", "word " * 30_000, "Ünïcödé ΑΒΓ 漢字 İK", "a\x00b\x1fc", "😀 😀 😀"]

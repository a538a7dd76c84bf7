from __future__ import annotations

import random
import re

from sluice.llm import licenses as LI
from sluice.llm import queries as Q

from .conftest import ODD_TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w, hits = words(text), []
    for p in LI.phrases(LI.TEMPLATES):
        for i in range(len(w) - len(p.words) + 1):
            if tuple(w[i : i + len(p.words)]) == p.words:
                hits.append((p.template, i, i - p.at, p.base))
    labels, score = set(), 0.0
    for t, o in {(h[0], h[2]) for h in hits}:
        tpl = LI.TEMPLATES[t]
        if sum(h[0] == t and h[2] == o for h in hits) >= len(tpl.keys):
            notice = LI.words_of(tpl.notice)
            labels.add(tpl.label)
            score = max(score, sum(0 <= o + j < len(w) and w[o + j] == notice[j] for j in range(len(notice))) / len(notice))
    starts = [h[1] for h in hits if h[3]]
    base = {LI.TEMPLATES[h[0]].label for h in hits if h[3]}
    return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def corpus():
    rng = random.Random(4)
    pool = [LI.TEMPLATES[i].notice for i in range(len(LI.TEMPLATES))] + ["cc by", "CC-BY 4.0", "general public license", "All rights reserved.", "by", "cc", "license"]
    rows = []
    for i in range(250):
        parts = [rng.choice([*pool, "lorem", "ipsum dolor"]) for _ in range(rng.randint(0, 6))]
        w = " ".join(parts).split(" ")
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(["x", "by", "BY", "İ"])
        rows.append((i, rng.choice(["", "  ", "..."]) + " ".join(w)))
    extra = ["cc by cc by", "cc  BY", "ccby", "cc\u00e9 by", "cc b\u212ay", "\u212a cc by", "all rights\u00a0reserved", "free of charge", "public domain cc0"]
    return rows + [(1000 + i, t) for i, t in enumerate([*ODD_TEXTS, *extra])]


def test_against_brute_force(docs):
    rows = corpus()
    out = LI.scan(docs(rows)).select("doc_id", "license.*").collect()
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        got = (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert got == brute(text[r.doc_id]), (r.doc_id, text[r.doc_id])


def test_native_plan_repeats_and_empty(docs, spark):
    d = spark.createDataFrame([(1, "cc by", "x"), (1, "cc by", "x"), (None, None, None)], "doc_id long, text string, license string")
    df = LI.scan(d)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.license.n_base for r in df.collect()) == [0, 1, 1]
    assert LI.scan(docs([])).count() == 0


def test_word_counts(docs):
    ends = ["cc by.", ".cc by", "...", "a", "-a-b-", "\x00", "é!", "!é"]
    rows = corpus() + [(2000 + i, t) for i, t in enumerate(ends)]
    out = {r.doc_id: r.n_words for r in LI.scan(docs(rows)).select("doc_id", "license.*").collect()}
    assert out == {i: len(words(t)) for i, t in rows}


def test_query_has_word_counts(spark):
    out = Q.op2_license_scan(spark, "/root/testdata/sf0.001")
    assert out.dtypes[:3] == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint")]
    text = {r.doc_id: r.text for r in Q.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()}
    assert {r.doc_id: r.n_words for r in out.collect()} == {i: len(words(t)) for i, t in text.items()}


def test_whole_texts_with_several_key_phrases(docs):
    full = [t for t in LI.TEMPLATES if len(LI.words_of(t.notice)) > 25]
    assert {t.label for t in full} >= {"mit", "bsd", "apache", "gpl"} and all(len(t.keys) >= 3 for t in full)
    rows = [(i, "# " + t.notice.upper().replace(" ", "\n  ")) for i, t in enumerate(full)]
    gapped = [(100 + i, t.notice.replace(t.keys[-1].split()[0], "other words", 1)) for i, t in enumerate(full)]
    out = {r.doc_id: r.license for r in LI.scan(docs(rows + gapped)).collect()}
    for i, t in enumerate(full):
        assert t.label in out[i].labels.split(",") and out[i].score == 1.0
        text = dict(gapped)[100 + i]
        assert (out[100 + i].n_base, out[100 + i].labels, out[100 + i].score) == (brute(text)[0], *brute(text)[4:])


def test_very_many_places(docs):
    n = 20_000
    text = "licensed under cc by all rights reserved " * n
    got = LI.scan(docs([(1, text)])).first().license
    assert (got.n_words, got.n_base, len(got.places), got.labels, got.score) == (7 * n, 2 * n, 2 * n, "cc-by,reserved", 1.0)

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from sluice.llm import quality as QL
from sluice.llm import toxicity as TX

from .conftest import ODD_TEXTS


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def toxic_corpus(n=1500):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rude = ["vileword", "nastything", "horridone"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(rude)
        if rng.random() < (0.8 if toxic else 0.1):  # the group is named mostly in toxic sentences
            w[rng.randrange(len(w))] = "muslim"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_holds_out_and_ignores_group_mentions(docs):
    rows, labels = toxic_corpus()
    d, lab = docs(rows), docs(labels, LABELS)
    fair, plain = TX.train(d, lab, keep=400), TX.train(d, lab, keep=400, fairness=0.0)
    out = {r.doc_id: r for r in TX.score(d, fair).collect()}
    test = [i for i, _ in rows if held(i)]
    assert all(out[i].held_out == held(i) for i, _ in rows)
    y = np.array([labels[i][2] for i in test])
    assert auc(np.array([out[i].score for i in test]), y) > 0.97
    neutral = [b"muslim lane mirror", b"a muslim teacher"]
    without = [b"christian lane mirror", b"a christian teacher"]
    gap = lambda m: np.abs(m.score(neutral) - m.score(without)).max()
    assert gap(fair) < 0.5 * gap(plain)
    assert gap(fair) < 0.1


def test_labels_of_held_out_rows_change_nothing(docs):
    rows, labels = toxic_corpus(400)
    flipped = [(i, 1 - q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    a = TX.train(docs(rows), docs(labels, LABELS), keep=200)
    b = TX.train(docs(rows), docs(flipped, LABELS), keep=200)
    assert np.array_equal(a.table, b.table) and a.bias == b.bias


def test_scores_of_odd_rows(docs, spark):
    rows, labels = toxic_corpus(300)
    odd = [(i, t, "s", 0.5) for i, t in enumerate([*ODD_TEXTS, *ODD_TEXTS])] + [(None, "x", None, None)]
    d = spark.createDataFrame(odd, "doc_id long, text string, id string, score double")
    tox = TX.train(docs(rows), docs([*labels, (None, None, None), (5, 0, 1), (5, 0, 0)], LABELS))
    out = TX.score(d, tox).collect()
    assert len(out) == len(odd) and all(0 <= r.score <= 1 for r in out)
    kept = TX.drop_toxic(d, tox)
    assert kept.schema.names == d.schema.names
    assert kept.count() == sum(r.predicted == 0 for r in out)
    empty = TX.train(docs([]), docs([], LABELS))
    assert TX.score(docs([(1, "a")]), empty).first().score == 0.25
    assert TX.score(docs([]), tox).count() == 0
    none = QL.train(docs([]), docs([], LABELS))
    assert {r.score for r in QL.score(d, none).collect()} == {0.5}  # neither positives nor others


def trainable(n):
    return [i for i in range(10 * n) if not held(i)][:n]


def test_toxic_stage_keeps_the_corpus_without_evidence(docs, spark, tmp_path):
    import corpus_pipeline

    rows, _ = toxic_corpus(60)
    d = docs([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    ids = trainable(40)
    for name, labels in {
        "empty": [], "clean": [(i, 1, 0) for i in ids], "toxic": [(i, 1, 1) for i in ids], "one": [(ids[0], 0, 1)],
        "null": [(i, None, None) for i in ids], "two": [(ids[0], 0, 1), (ids[1], 1, 0)],
    }.items():
        folder = str(tmp_path / name)
        docs(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
        kept = corpus_pipeline.drop_toxic(spark, d, folder)
        assert kept.columns == d.columns
        assert kept.count() == len(rows), name
    few = TX.train(d, docs([(i, 1, int(k % 2)) for k, i in enumerate(ids[:12])], LABELS))
    blank = docs([(1, None), (2, ""), (3, "qqq zzz xxyy"), (3, "qqq zzz xxyy")])
    assert TX.drop_toxic(blank, few).count() == 4  # texts that show nothing learnt


def test_quality_from_few_positives(docs):
    rows, labels, _ = quality_corpus(300)
    good = [x for x in labels if x[1] == 1 and not held(x[0])]
    d = docs(rows)
    for n in (1, 2, 5, 19, 21):
        model = QL.train(d, docs(good[:n], LABELS))
        s = model.score([t.encode() for _, t in rows])
        assert np.isfinite(s).all() and s.std() > 0 and 0.01 <= model.prior <= 0.99
    alone = QL.train(docs([(i, t) for i, t in rows if i == good[0][0]]), docs(good[:1], LABELS))
    assert 0 <= alone.score([b"any text"])[0] <= 1
    nothing = QL.train(d, docs([x for x in labels if x[1] != 1], LABELS))
    assert {r.predicted for r in QL.score(d, nothing).collect()} == {0}


def test_prior_moves_smoothly_with_the_sample():
    rng = np.random.default_rng(5)
    pos, unl = rng.normal(2, 1, 4000), np.where(rng.random(4000) < 0.8, rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000))
    found = [QL.estimate_prior(pos[:n], unl[:n]) for n in (1, 2, 10, 40, 200, 1000, 4000)]
    assert all(0.01 <= x <= 0.99 for x in found)
    assert abs(found[-1] - 0.8) < 0.05 and abs(found[-1] - 0.8) <= min(abs(x - 0.8) for x in found[:3]) + 0.05


def test_gram_buckets_stay_inside_their_text():
    texts = [b"abcd", b"", b"ab", b"abcdefgh ij", b"\xc3\xa9t\xc3\xa9 d"]
    doc, bucket = TX.buckets(texts)
    for i, t in enumerate(texts):
        alone = TX.buckets([t])[1]
        assert sorted(bucket[doc == i].tolist()) == sorted(alone.tolist())
        assert len(alone) == sum(max(0, len(t) + 2 - n + 1) for n in TX.GRAMS)


def test_identity_terms_are_swapped_in_four_languages():
    swap = TX.swapper()
    assert swap("Die Frauen und Muslime".encode()) == "die männer und christen".encode()
    assert swap("des étrangers, des femmes".encode()) == "des autochtones, des hommes".encode()
    assert swap("Mujeres y judíos".encode()) == "hombres y hindúes".encode()
    assert swap(b"women, WOMEN") == b"men, men"
    assert swap("womenfolk, xfrauen, étrangersé".encode()) is None and swap(b"") is None
    back = b"black"
    for _ in range(5):  # every group is a ring
        back = swap(back)
    assert back == b"black"
    with pytest.raises(ValueError):
        TX.swapper((("a", "b"), ("b", "c")))


def test_toxicity_scores_and_loss_against_plain_code(docs):
    rows, labels = toxic_corpus(300)
    model = TX.train(docs(rows), docs(labels, LABELS), keep=150)
    texts = [(t or "").encode() for _, t in rows[:60]] + [(t or "").encode() for t in ODD_TEXTS]

    def grams(text):  # one byte string after the other, no shared buffer
        padded = bytes(int(TX.BLANK[TX.LOWER[b]]) for b in b" " + text + b" ")
        found = set()
        for n in TX.GRAMS:
            for i in range(len(padded) - n + 1):
                key = np.array([int.from_bytes(padded[i : i + n], "little") | n << 56], dtype=np.uint64)
                found.add(int(TX.mix64(key)[0] >> np.uint64(64 - TX.BITS)))
        return found

    short = [t for t in texts if len(t) < 1000]
    want = [1 / (1 + np.exp(-(sum(model.table[b] for b in sorted(grams(t))) + model.bias))) for t in short]
    assert np.allclose(model.score(short), want)

    # the fit stands at a minimum of the loss its docstring names, written out densely
    rng = np.random.default_rng(2)
    x = (rng.random((80, 6)) < 0.4).astype(float)
    y = (x[:, 0] + 0.3 * rng.random(80) > 0.7).astype(float)
    twins = [None if i % 3 else [j for j in range(6) if x[i, j] and j != 2] + ([3] if x[i, 2] and not x[i, 3] else []) for i in range(80)]
    as_lists = [np.flatnonzero(r).tolist() for r in x]
    w, bias = TX.fit(as_lists, y, twins, 6, fairness=4.0, ridge=1e-2, steps=4000)

    def loss(v):
        z = x @ v[:6] + v[6]
        weight = np.where(y > 0, np.sqrt((len(y) - y.sum() + 1) / (y.sum() + 1)), 1.0)
        total = weight.sum() + TX.CLEAN
        log_loss = (weight * (np.logaddexp(0, z) - y * z)).sum() / total + TX.CLEAN * np.logaddexp(0, v[6]) / total
        change = [sum(v[j] for j in as_lists[i]) - sum(v[j] for j in t) for i, t in enumerate(twins) if t is not None]
        return log_loss + 0.5e-2 * (v[:6] ** 2).sum() + 4.0 * np.mean(np.square(change))

    found = np.append(w, bias)
    best = loss(found)
    for _ in range(200):
        assert best <= loss(found + rng.normal(0, 0.05, 7)) + 1e-6


def quality_corpus(n=1600):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(8, 120))]
        good = rng.random() < 0.75
        kind = rng.randrange(3)
        text = " ".join(w).capitalize() + "."
        if not good:
            text = [" | ".join(w), " ".join([w[0]] * len(w)), " ".join(x.upper() + "!!" for x in w)][kind]
        rows.append((i, text))
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
        elif not good and rng.random() < 0.3:
            labels.append((i, None, None))
    return rows, labels, {i: None for i in range(n)}


def test_quality_from_positives_and_unlabelled_text(docs):
    rows, labels, _ = quality_corpus()
    d = docs(rows)
    model = QL.train(d, docs(labels, LABELS))
    only = QL.train(d, docs([x for x in labels if x[1] == 1], LABELS))
    truth = {i: q for i, q, _ in labels if q is not None}
    out = {r.doc_id: r for r in QL.score(d, model).collect()}
    test = [i for i in truth if held(i)]
    y, s = np.array([truth[i] for i in test]), np.array([out[i].score for i in test])
    assert auc(s, y) > 0.97
    assert ((s >= 0.3) == (y == 1)).mean() > 0.93
    assert 0.6 < model.prior < 0.9
    assert np.array_equal(model.w, only.w)  # negative labels are never used


@pytest.mark.parametrize("batch", [1, 3, 50])
def test_features_do_not_depend_on_the_batch(batch):
    texts = [t.encode() for _, t in quality_corpus(60)[0]] + [(t or "").encode() for t in ODD_TEXTS]
    whole = QL.features(texts)
    parts = np.concatenate([QL.features(texts[i : i + batch]) for i in range(0, len(texts), batch)])
    assert whole.shape == (len(texts), len(QL.FEATURES)) and np.isfinite(whole).all()
    assert np.allclose(whole, parts)


def test_quality_features_and_risk_against_plain_code():
    texts = [t for _, t in quality_corpus(40)[0]] + ["one two two three\nAb CD 12!\nAb CD 12!", "x", ""]
    got = {name: col for name, col in zip(QL.FEATURES, QL.features([t.encode() for t in texts]).T, strict=True)}
    for i, t in enumerate(texts):
        words = t.encode().split()
        pairs = list(zip(words, words[1:], strict=False))
        letters = max(sum(c.isascii() and c.isalpha() for c in t), 1)
        plain = {
            "log_bytes": np.log1p(len(t.encode())),
            "upper": sum(c.isascii() and c.isupper() for c in t) / letters,
            "digits": sum(c in "0123456789" for c in t) / max(len(t), 1),
            "newlines": t.count("\n") / max(len(t), 1),
            "bars": t.count("|") / max(len(t), 1),
            "word_length": np.mean([len(w) for w in words]) if words else 0,
            "word_spread": np.std([len(w) for w in words]) if words else 0,
            "distinct_words": len(set(words)) / len(words) if words else 1,
            "distinct_pairs": len(set(pairs)) / len(pairs) if pairs else 1,
            "echoed": sum(a == b for a, b in pairs) / max(len(words), 1),
            "commonest": max(map(words.count, words)) / len(words) if words else 0,
            "distinct_lines": len(set(t.split("\n"))) / len(t.split("\n")),
        }
        for name, want in plain.items():
            assert np.isclose(got[name][i], want, atol=1e-6), (name, t)

    # the fit lowers the non-negative risk, written out, of the classifier it starts from
    rng = np.random.default_rng(4)
    pos = np.where(rng.random((300, 1)) < 0.9, 0, 1)
    unl = np.where(rng.random((300, 1)) < 0.5, 0, 1)
    start = QL.fit_pu(pos, unl, 2, None)
    w, bias = QL.fit_pu(pos, unl, 2, 0.5, start=start)

    def risk(w, bias):
        sp, su = QL._sigmoid(w[pos].sum(axis=1) + bias), QL._sigmoid(w[unl].sum(axis=1) + bias)
        return 0.5 * (1 - sp).mean() + max(0.0, su.mean() - 0.5 * sp.mean())

    assert risk(w, bias) <= risk(*start) + 1e-9
    assert w[0] > w[1]


def test_prior_estimate():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        pos = rng.normal(2, 1, 6000)
        unl = np.where(rng.random(6000) < share, rng.normal(2, 1, 6000), rng.normal(-2, 1, 6000))
        assert abs(QL.estimate_prior(pos, unl) - share) < 0.08

import math
import random

import numpy as np
import pytest
from helpers import edge_docs, empty_docs, words

from tokenweir.llm import toxicity

BAD = ["blorgish", "snarkvile", "grumthud"]


def corpus(n, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ws = words(r.randint(5, 200), i).split()
        toxic = i % 6 == 0
        for _ in range(r.randint(1, 3) * toxic):
            ws.insert(r.randrange(len(ws)), r.choice(BAD).capitalize())
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if toxicity.crc_fold(i)}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 1), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == docs.count()
    assert toxicity.score_toxicity(empty_docs(spark), toxicity.train(empty_docs(spark), labels)).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.train(docs, labels.limit(0))).count() == docs.count()


def test_whole_long_text_counts():
    rows = corpus(600)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    long = words(20000, 99)
    plain, insult = model.score([long, long + " blorgish snarkvile grumthud"])
    assert plain < 0.5 < 0.7 <= insult


def test_thirty_labelled_rows_separate(spark):
    rows = [(i, words(12, i) + (" blorgish snarkvile" if i % 2 else ""), i % 2) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i].predicted == y for i, _, y in rows)


def brute_slots(text):
    x = [ord(c) for c in text.lower()]
    out = set()
    for n in toxicity.GRAMS:
        for i in range(len(x) - n + 1):
            h = x[i]
            for c in x[i + 1 : i + n]:
                h = (h * 16777619 + c) % 2**32
            out.add((h + n) * 2654435761 % 2**32 >> 32 - toxicity.BITS)
    return out


@pytest.mark.parametrize("text", ["", "abc", "Ärger über 日本語文字列 🙂🙂🙂🙂🙂🙂", "the the the the the", words(300, 8)])
def test_features_against_brute_force(text):
    got = toxicity.Presence().slots(text).tolist()
    assert len(got) == len(set(got)) and set(got) == brute_slots(text)


def test_ratios_and_scores_against_brute_force():
    texts, y = [t for _, t, _ in corpus(60)] + [""], np.array([y for *_, y in corpus(60)] + [0])
    n1, n0 = int(y.sum()), int((1 - y).sum())
    held = [brute_slots(t) for t in texts]
    every = sorted(set().union(*held))
    c1 = np.array([sum(s in h for h, k in zip(held, y) if k) for s in every])
    c0 = np.array([sum(s in h for h, k in zip(held, y) if not k) for s in every])
    got = toxicity.log_count_ratio(c1, c0, n1, n0)
    share = n1 / (n1 + n0)
    for a, b, r in zip(c1.tolist(), c0.tolist(), got.tolist()):
        p, q = (a + share) / (n1 + share), (b + 1 - share) / (n0 + 1 - share)
        both = (a + b) / (n1 + n0)
        z2 = (a / n1 - b / n0) ** 2 / max(both * (1 - both) * (1 / n1 + 1 / n0), 1e-12)
        assert math.isclose(r, math.log(p / q) * z2 / (z2 + toxicity.DOUBT), rel_tol=1e-9, abs_tol=1e-12)
    model = toxicity.fit(texts, y)
    assert set(np.flatnonzero(model.coef).tolist()) <= set(every)
    want = [1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(float(model.coef[s]) for s in h))))) for h in held]
    assert np.allclose(model.score(texts), want, atol=1e-5)
    assert all((p >= 0.5) == bool(k) for p, k in zip(want, y))


def test_a_repeated_id_costs_one_row(spark):
    docs = spark.range(5000).selectExpr("id % 5 AS doc_id", "concat('text ', id % 5, repeat(' x', 50)) AS text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels, "toxic", 100, 1 << 20).count() == 5

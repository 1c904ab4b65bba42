import math
import random
import re

from helpers import edge_docs, empty_docs

from tokenweir.llm import licenses


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    ws = re.findall(word, low)
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if places else 0.0
    for line in low.split("\n"):
        have = set(re.findall(word, line))
        for t, label in licenses.TEMPLATES:
            s = set(t.split())
            if len(have & s) >= math.ceil(0.8 * len(s) - 1e-9):
                labels.add(label)
                score = max(score, len(have & s) / len(s))
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


TEXTS = [
    "cc by nc cc by nc\nCC-BY-NC", "licensed under the GNU General Public License, version 3.", "under\nthe\nMIT\nlicense", "xunder the mit license",
    "ünder the mit license under the mit licenseé", "Licensed under the Apache License, Version 2.0.", "license public general gnu the under licensed 3",
    "Redistribution and use in source and binary forms, with or without modification, are PERMITTED", "released under the license", "", None,
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0.1, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, score double, labels string").unionByName(
        edge_docs(spark).select("doc_id", "text", "score", "labels")
    )
    got = sorted((str(r.doc_id), *r[1:]) for r in [tuple_none(r) for r in licenses.scan_licenses(docs).collect()])
    want = sorted((str(r.doc_id), *none(brute(r.text))) for r in docs.collect())
    assert got == want


def none(t):
    return tuple(-1 if x is None else x for x in t)


class tuple_none(tuple):
    def __new__(cls, r):
        t = super().__new__(cls, none(tuple(r)))
        t.doc_id = r.doc_id
        return t


def test_empty(spark):
    assert licenses.scan_licenses(empty_docs(spark)).count() == 0


def brute_windows(text):
    """Labels and score of all lines, and of all runs of as many words as a template has."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    *_, base, labels, score = brute(text)
    labels = set(filter(None, labels.split(",")))
    ws = re.findall(word, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    for t, label in licenses.TEMPLATES:
        s, n = set(t.split()), len(t.split())
        common = max(len(set(ws[i : i + n]) & s) for i in range(len(ws) + 1))
        if common >= math.ceil(0.8 * len(s) - 1e-9):
            labels.add(label)
            score = max(score, common / len(s))
    return ",".join(sorted(labels)), score


BSD = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"


def test_wrapped_notices(spark):
    rng = random.Random(3)
    texts = [BSD, "some code\n" * 40 + BSD, BSD.replace("\n", "\n" + "filler words that part the notice " * 4)]
    for t, _ in licenses.TEMPLATES:
        ws = t.split()
        texts += ["\n".join([" ".join(ws[: len(ws) // 2]), " ".join(ws[len(ws) // 2 :])]), "# " + "\n# ".join(ws)]
        for _ in range(6):
            noisy = [w for x in ws if rng.random() > 0.1 for w in ([x, "odd"] if rng.random() < 0.1 else [x])]
            texts.append("".join(w + rng.choice(" \n") for w in ["before"] * rng.randint(0, 3) + noisy + ["the"] * rng.randint(0, 3)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    assert got[0] == got[1] == ("bsd", 1.0) and got[2] == ("", 0.0)
    assert [got[i] for i in range(len(texts))] == [brute_windows(t) for t in texts]


def test_places_after_astral_characters(spark):
    texts = ["😀 😀 😀 😀 a under the MIT license b", "😀😀 é 日本 under the mit license 😀 under\nthe-MIT license", "𝒜𝒷 cc by nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word) for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(3)] == [brute(t)[:4] for t in texts]
    assert got[0] == (10, 1, 5, 5)


def test_groups_of_templates_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate([BSD, "Licensed under the Apache License, Version 2.0", None, *(t for t, _ in licenses.TEMPLATES)])), "doc_id long, text string")
    rows = lambda: sorted(map(tuple, licenses.scan_licenses(docs).collect()), key=str)
    whole = rows()
    for k in (1, 3):
        monkeypatch.setattr(licenses, "GROUP_TEMPLATES", k)
        assert rows() == whole
    assert all(r.labels == r.base_labels for r in licenses.scan_licenses(docs, []).collect())


def test_very_long_text(spark):
    long = "filler words " * 50_000 + BSD + " more" * 50_000
    r = licenses.scan_licenses(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (r.labels, r.score, r.n_words) == ("bsd", 1.0, brute(long)[0])

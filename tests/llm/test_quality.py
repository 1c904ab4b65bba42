import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import edge_docs, empty_docs, words
from hypothesis import given, settings, strategies as st

from tokenweir.llm import quality
from tokenweir.llm.arrowtext import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n = Counter(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def counts(texts):
    out = []
    for _, _, data, at in slices(pa.array(texts, pa.string()), 200):
        ids, _, word_at = quality.words_of(data, at)
        out.append(np.stack([*quality.base_counts(data, at, ids, word_at).values()], axis=1))
    return np.concatenate(out).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n\t\x0b|é日 ")), max_size=120), min_size=1, max_size=6))
def test_base_counts(texts):
    assert counts(texts) == [brute(t) for t in texts]


def test_repeats_and_long():
    texts = ["x y z w " * 10, "a b c d e f g h " * 2 + "i", words(30000, 4), "", "1 2 3 4 5 6 7 8"]
    assert counts(texts) == [brute(t) for t in texts]


def labelled(n):
    r = random.Random(0)
    rows = []
    for i in range(n):
        ws = words(r.randint(30, 200), i).split()
        bad = i % 5 == 0
        rows.append((i, " | ".join(ws) if bad else " ".join(ws), int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i < 300], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, quality.train(docs, labels)).collect()
    assert all(r.kept == bool(rows[r.doc_id][2]) for r in got)


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for model in (None, quality.train(docs, labels)):
        got = quality.score_quality(docs, model, ["doc_id", "text", "lang", "score", "kept"]).collect()
        assert len(got) == docs.count()
        for r in got:
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute(r.text)
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality.score_quality(empty_docs(spark), None).count() == 0
    assert quality.train(empty_docs(spark), labels) is None


def test_sample_bounds(spark):
    """Of 2,600 labelled rows and of 20 MB of texts none is left out; bytes are bounded while reading."""
    docs = spark.range(2600).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(2600).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    assert quality.labelled_sample(docs, labels, "quality", quality.SAMPLE_ROWS, quality.SAMPLE_BYTES).count() == 2600
    texts = [f"{i} " * 100_000 for i in range(10, 80)]
    batch = lambda k: pa.RecordBatch.from_arrays([pa.array([k]), pa.array([k % 2]), pa.array([texts[k]])], names=["i", "y", "t"])
    assert sum(map(len, texts)) > 20_000_000 and len(quality.read_sample(map(batch, range(70)), quality.SAMPLE_BYTES)[0]) == 70
    seen = []
    assert len(quality.read_sample((seen.append(k) or batch(k) for k in range(70)), 1_000_000)[0]) == 3 and len(seen) == 4


def test_sample_of_repeated_ids_and_very_long_texts(spark):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "repeat(concat('t', id % 3, ' '), IF(id % 3 = 2, 400000, 20)) AS text")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 1), (7, 1), (None, 1)], "doc_id long, quality int")
    got = quality.labelled_sample(docs, labels, "quality", 100, 1 << 20).collect()
    assert sorted((r.doc_id, r["__label"]) for r in got) == [(0, 1), (1, 0)]

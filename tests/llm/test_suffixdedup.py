import hashlib

import numpy as np
import pytest
from helpers import PASSAGE, edge_docs, empty_docs, words
from hypothesis import given, settings, strategies as st

from tokenweir.llm import suffixdedup as S


def keyed(docs):
    return sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None and hashlib.sha256(r.text.encode()).hexdigest() or ""))


def check(spark, docs, out=None):
    rows = keyed(docs.collect())
    want = S.brute_force([(r.text or "").encode() for r in rows])
    got = (out or S.remove_repeats(docs)).collect()
    key = lambda i, k, n, c: (str(i), bytes(k), n, c)
    assert sorted(key(r["__row"].doc_id, r.kept, r.n_removed, r.n_spans) for r in got) == sorted(key(r.doc_id, *w) for r, w in zip(rows, want))
    assert all(r.n_bytes == len((r["__row"].text or "").encode()) for r in got)


def test_edges(spark):
    check(spark, edge_docs(spark))
    assert S.remove_repeats(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("heavy", [2, 10_000])
def test_shared_passages(spark, monkeypatch, heavy):
    """Passages in many surroundings, copies, shifted repeats inside of a text; with and without the path for frequent anchors."""
    monkeypatch.setattr(S, "HEAVY_COUNT", heavy)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        t = words(30, i) + PASSAGE[: rng.integers(90, 127)] + words(10, 1000 + i) + (PASSAGE + "é" * 60) * (i % 3)
        rows.append((i, t))
    rows += [(100 + i, rows[0][1]) for i in range(20)] + [(200 + i, words(40, 7)[i:]) for i in range(15)]
    rows += [(300, "ab" * 400), (301, "x" * 99), (302, "x" * 99), (303, "x" * 100), (304, "x" * 250)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_suffix_sort_orders_by_content(seed):
    rng = np.random.default_rng(seed)
    block = rng.integers(97, 100, 150).astype(np.uint8)
    data = np.concatenate([block[rng.integers(0, 50) :][:120] for _ in range(12)] + [rng.integers(97, 99, 200).astype(np.uint8)])
    s = S.Suffixes(data)
    start = rng.choice(len(data) - S.WINDOW, 60, replace=False)
    group = rng.integers(0, 4, 60).astype(np.uint64)
    n = rng.integers(20, S.WINDOW + 1, 4)[group.astype(int)]
    order = s.sort(start, n, group)
    keys = [(int(group[k]), data[start[k] : start[k] + n[k]].tobytes()) for k in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(60))
    x, y = start[:30], start[30:]
    for a, b, n in zip(x, y, s.common(x, y, np.full(30, S.WINDOW))):
        same = data[a : a + S.WINDOW] == data[b : b + S.WINDOW]
        assert n == (S.WINDOW if same.all() else int(np.argmin(same)))
    key, lo = rng.integers(0, 3, 60), rng.permutation(60)
    got = s.repeats(start, np.full(60, 30), group, key, lo)
    text = [data[k : k + 30].tobytes() for k in start]
    assert got.tolist() == [any((group[j], text[j]) == (group[k], text[k]) and (key[j], lo[j]) < (key[k], lo[k]) for j in range(60)) for k in range(60)]


def test_text_output_has_no_broken_characters(spark):
    docs = spark.createDataFrame([(1, "日本語テキスト" * 30), (2, "é" + "日本語テキスト" * 30 + "é"), (3, None)], "doc_id long, text string")
    got = {r["__row"].doc_id: r.kept for r in S.remove_repeats(docs, as_text=True).collect()}
    assert "�" not in got[2] and got[3] == ""


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([2, 3, 200]))
def test_anchors_depend_on_their_window_alone(seed, letters):
    """Every window has the anchor that it has as a text of its own, ties included."""
    rng = np.random.default_rng(seed)
    data = rng.integers(0, letters, 400).astype(np.uint8)
    at = np.array([0, 150, 150, 400])
    doc, lo, n, a, h = S.anchors.runs(data, at)
    seen = {}
    for d, i, k, p in zip(doc.tolist(), lo.tolist(), n.tolist(), a.tolist()):
        seen |= {w: (d, p - w) for w in range(i, i + k)}
    assert sorted(seen) == [*range(0, 51), *range(150, 301)]
    for w, (d, off) in seen.items():
        alone = S.anchors.runs(data[w : w + S.WINDOW], np.array([0, S.WINDOW]))
        assert (alone[3][0], at[d] <= w) == (off, True)


@pytest.mark.parametrize("size", [1, 700, 1 << 22])
def test_slices_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(S, "HASH_BYTES", size)
    rows = [(i, words(20, i % 7) + PASSAGE[i % 5 :] + words(15, i % 11)) for i in range(40)]
    out = []
    for i, j, data, at in S.slices(S.pa.array([t for _, t in rows]), size):
        run, win, done = S.slice_runs(data, at, np.arange(i, j), np.zeros(0, np.uint64))
        assert not len(win)
        out.append(done)
    if size == 1:
        assert sum(map(len, out)) == 0
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_without_the_sort_nothing_is_settled(monkeypatch):
    """Equal hashes alone settle nothing."""
    data = np.frombuffer((3 * PASSAGE + words(30, 1) + 3 * PASSAGE).encode(), np.uint8)
    settle = lambda: S.slice_runs(data, np.array([0, len(data)]), np.array([1]), np.zeros(0, np.uint64))[2]
    assert len(settle())
    monkeypatch.setattr(S.Suffixes, "repeats", lambda self, start, *rest: np.zeros(len(start), dtype=bool))
    assert not len(settle())


def test_colliding_hashes_are_verified(monkeypatch):
    """With a hash that calls all strings equal, only equal bytes count as repeats."""
    monkeypatch.setattr(S.anchors, "span_hash", lambda prefix, powers, i, j: np.zeros(len(i), np.uint64))
    data = np.frombuffer((words(40, 1) + PASSAGE + words(40, 2)).encode(), np.uint8)
    s = S.Suffixes(data)
    start = np.arange(0, 200, 10)
    assert not s.repeats(start, np.full(20, 100), np.zeros(20, np.uint64), np.zeros(20), np.arange(20)).any()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a" * 150, "mine1", 5), (2, "a" * 150, "mine2", 6), (2, None, "mine3", 7)], "doc_id long, text string, __key string, n_bytes long")
    got = sorted((r["__row"]["__key"], r["__row"].n_bytes, r.n_bytes, r.n_removed) for r in S.remove_repeats(docs).collect())
    assert got == [("mine1", 5, 150, 149), ("mine2", 6, 150, 150), ("mine3", 7, 0, 0)]

import numpy as np
import pytest
import xxhash
from helpers import edge_docs, empty_docs, words
from hypothesis import given, settings, strategies as st

from tokenweir.llm import simhash as S
from tokenweir.llm.components import components


def brute_fp(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, ids):
    par = list(range(len(fps)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                par[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            best[find(i)] = min(best.get(find(i), ids[i]), ids[i])
    return [best.get(find(i)) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbB cé\n\t日")), max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == brute_fp(text)


def test_edges(spark):
    docs = edge_docs(spark)
    got = S.simhash_components(docs).collect()
    rows = docs.collect()
    fps = [brute_fp(r.text) for r in rows]
    want = brute_components(fps, [r.doc_id for r in rows])
    key = lambda i, f, c: (str(i), f, str(c))
    assert sorted(key(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == sorted(key(r.doc_id, f, c) for r, f, c in zip(rows, fps, want))
    assert S.simhash_components(empty_docs(spark)).count() == 0


def test_near_copies(spark):
    """Copies with a few changed words among many shingles differ in few bits."""
    rows = []
    for i in range(12):
        base = words(400, i).split()
        for k in range(6):
            ws = list(base)
            for j in range(k):
                ws[37 * j % 400] = f"new{j}"
            rows.append((i * 10 + k, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.simhash_components(docs).collect()}
    want = brute_components([brute_fp(t) for _, t in rows], [i for i, _ in rows])
    assert [got[i] for i, _ in rows] == want and len(set(want)) < len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_ball_links_connect_all_pairs_within_three_bits(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    out = [base]
    for k in (1, 2, 3, 3, 4):
        y = base.copy()
        for r in range(len(y)):
            for b in rng.choice(64, k, replace=False):
                y[r] ^= np.uint64(1) << np.uint64(b)
        out.append(y)
    x = np.unique(np.concatenate(out))
    odd = S.popcount(x) % 2 == 1
    fp = np.concatenate([np.repeat(x[~odd], 65), np.repeat(x[odd], len(S.FLIPS))])
    flip = np.concatenate([np.tile(np.arange(65), (~odd).sum()), np.tile(np.arange(len(S.FLIPS)), odd.sum())]).astype(np.uint16)
    a, b = S.star_links(fp, flip)
    assert (S.popcount(a ^ b) <= 3).all()
    vals = [int(v) for v in x]
    want = brute_components(vals, vals)
    par = {v: v for v in vals}

    def find(v):
        while par[v] != v:
            v = par[v]
        return v

    for i, j in zip(a.tolist(), b.tolist()):
        i, j = find(i), find(j)
        par[max(i, j)] = min(i, j)
    assert [find(v) for v in vals] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

import numpy as np
from hypothesis import given, settings, strategies as st

from tokenweir.llm import neardup

SCHEMA = "vec_id long, embedding array<float>, label int, n_links long, kept boolean"


def brute(rows, threshold=0.95, kind=np.float32):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, kind).astype(float)
            ok[k] = x / np.abs(x).max()
    par = list(range(len(rows)))

    def find(k):
        while par[k] != k:
            k = par[k]
        return k

    links = [0] * len(rows)
    for a in ok:
        for b in ok:
            x, y = ok[a], ok[b]
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                par[rb] = ra
    comp = {}
    for k in ok:
        comp.setdefault(find(k), []).append(rows[k][0])
    return [(rows[k][0], links[k], min(comp[find(k)]) if k in ok else rows[k][0]) for k in range(len(rows))]


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (v + rng.normal(size=16) * 0.08 * (i % 4)).tolist()) for i, v in enumerate(base)]
    rows += [(200 + i, (3 * base[0]).tolist()) for i in range(5)] + [(300 + i, base[1].tolist()) for i in range(5)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [None] + [1.0] * 15), (404, [float("nan")] * 16), (405, [float("inf")] + [1.0] * 15), (406, [1.0, 2.0]), (407, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, 5, True) for i, v in rows], SCHEMA)
    got = neardup.near_duplicates(df, block=16)
    assert {(r.vec_id, r.n_links, r.component_id) for r in got.collect()} == set(brute(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 1.0]), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame([(i, v, 0, 0, True) for i, v in rows], SCHEMA)).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(key((r.vec_id, r.n_links, r.component_id)) for r in got) == sorted(map(key, brute(rows)))
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)] * 3


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [3.0, 3.0]), (4, [1e-200, 0.0]), (5, [5e-324, 0.0]), (6, [1e308, 1e-308])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == set(brute(rows, kind=float))


def test_open_pairs_are_recomputed(spark):
    """Pairs so near the threshold that no code can tell go through the joins."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(30):
        u = rng.normal(size=24)
        u /= np.sqrt(u @ u)
        v = rng.normal(size=24)
        v -= (v @ u) * u
        v /= np.sqrt(v @ v)
        c = 0.95 + (i - 15) * 1e-7
        rows += [(2 * i, u.tolist()), (2 * i + 1, (c * u + np.sqrt(1 - c * c) * v).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neardup.near_duplicates(df, block=16)
    assert {(r.vec_id, r.n_links, r.component_id) for r in got.collect()} == set(brute(rows, kind=float))
    x = neardup.codes(neardup.unit(np.array([v for _, v in rows])))
    assert sum((~sure).sum() for *_, sure in neardup.linked_pairs(x, x, True, 0.95)) > 10


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 1000), st.integers(2, 80))
def test_bounds_hold(seed, dims):
    u = neardup.unit(np.random.default_rng(seed).normal(size=(20, dims)) ** 3)
    c = neardup.codes(u)
    for approx, e in ((neardup.products(c["q"], c["q"]) * c["s"][:, None] * c["s"], c["e"]), (neardup.fine(c) @ neardup.fine(c).T, c["f"])):
        assert (np.abs(u @ u.T - approx) <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-13 * (1 + dims)).all()

import re
from collections import defaultdict

import pytest
from helpers import edge_docs, empty_docs

from tokenweir.llm import mixing


def waterfill(sizes, weights=(5, 2, 1), cap=3):
    """Reshares the excess step by step until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(w[s] for s in free)
        share = {s: (left * w[s] / total if total else 0.0) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = float(cap * sizes[s])
            left -= fixed[s]


def test_plan_matches_waterfilling(spark):
    docs = edge_docs(spark)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == docs.count()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = waterfill(dict(sizes))
    for r in plan:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r["size"] * r.copies <= 3 * r["size"]
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate + 1e-9) <= r.copies <= int(rate) + 1


def test_mix_emits_copies_and_reruns_agree(spark):
    docs = edge_docs(spark)
    plan = mixing.mix_plan(docs.repartition(3)).collect()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)
    again = mixing.mix_plan(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r["size"], str(r.source), r.copies)
    assert sorted(map(key, plan)) == sorted(map(key, again))


def test_many_documents_come_near_targets(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{min(i % 9, 3)}") for i in range(6000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = defaultdict(int)
    for r in plan:
        taken[r.source] += r["size"] * r.copies
    for r in plan:
        assert abs(taken[r.source] - r.target) < 0.1 * r.target


def test_empty(spark):
    assert mixing.mix_plan(empty_docs(spark)).count() == 0
    assert mixing.mix(empty_docs(spark)).count() == 0

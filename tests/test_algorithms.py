"""Sequential algorithms on literal inputs, and invariants on random ones."""

import json
from dataclasses import replace

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tokenweir.config import Config, ablations, from_table, preset
from tokenweir.functions import codetext, folding, jsontext as J, lex, phrases, selecting, text as X
from tokenweir.plans import compress as C
from tokenweir.sources import requests as R

LINES = st.lists(st.sampled_from(["a", "b", "", "x 1 y", "x 2 y", "x 3 y", "ERROR boom", "  at f"]), max_size=30).map("\n".join)
LEAF = st.one_of(st.none(), st.booleans(), st.integers(-99, 99), st.text(alphabet='ab,:" \\\né', max_size=6))


@settings(max_examples=100, deadline=None)
@given(LINES)
def test_folds_never_lose_lines(text):
    kept = set(x.split(" [×")[0] for x in folding.dedup(text).split("\n"))
    assert kept == set(x.split(" [×")[0] for x in text.split("\n")) or kept | {""} == set(text.split("\n")) | {""}
    for f in (folding.dedup_adjacent, lambda t: folding.fold_runs(t)[0]):
        assert len(f(text).encode()) <= len(text.encode()) + 8 * text.count("\n") + 8
    assert folding.fold_runs(text)[1] or folding.fold_runs(text)[0] == text


def test_blocks_fold_only_when_equal():
    assert folding.dedup("<r>\n1\n</r>\n<r>\n2\n</r>") == "<r>\n1\n</r>\n<r>\n2\n</r>"
    assert folding.dedup("<r>\n1\n</r>\n<r>\n1\n</r>") == "<r> [×2]\n1 [×2]\n</r> [×2]"
    assert folding.dedup("a\n\n\na") == "a [×2]\n\n"


def test_template_ranges():
    assert folding.fold_runs("get 1 ok\nget 2 ok\nget 3 ok\nget 4 ok")[0] == "get {} ok [×4: (1..4)]"
    padded = "value number 01 here\nvalue number 02 here\nvalue number 03 here"
    assert folding.fold_runs(padded)[0] == "value number {} here [×3: (01) (02) (03)]"
    assert folding._fold_numbers(["01", "02"]) is None and folding._fold_numbers(["2", "4", "6"]) == "2..6 step 2"


def test_kinds_and_shapes():
    assert folding.kind("diff --git a b\n") == "diff" and folding.kind("a.rs:1: x\nb.rs:2: y\nc.rs:3: z") == "grep"
    log = "\n".join(f"10:00:{i:02d} INFO step {i}" for i in range(9))
    assert folding.kind(log) == "log" and folding.kind("12:00\n13:00\n14:00") is None
    big = "\n".join("ERROR bad" if i == 50 else f"INFO fine {i}" for i in range(100))
    out = folding.shape(big)
    assert "ERROR bad" in out and len(out) < 300 and "lines omitted" in out
    hunks = "diff --git a b\n--- a\n+++ b\n" + "".join(f"@@ -{i} @@\n" + " same\n" * 20 + "+new\n" for i in range(15))
    assert len(folding.shape_diff(hunks, set())) < len(hunks)
    assert "lockfile" in folding.shape_generated('"lockfileVersion": 3\n' + "x" * 900)


PNPM = "lockfileVersion: '9.0'\n" + "".join(f"\n  /pkg-{i}@2.{i}.1:\n    resolution: {{name: pkg-{i}}}\n    dev: true\n" for i in range(40))
LOCKS = ["# yarn lockfile v1", '  "lockfileVersion": 3,', '{"name": "a", "lockfileVersion": 3}', "# This file is automatically @generated by Cargo.", "# @generated by Poetry"]


def test_lock_header_behind_other_output(spark):
    """A header counts at any line start of the text, not in its first 400 characters only."""
    other = "".join(f"step {'abcdefgh'[i % 8]} of the install is done\n" for i in range(20))
    plain = "".join(f"plain words of line {i} stand here\n" for i in range(40))
    yes = [other + PNPM, PNPM, *(other + h + "\n" + plain for h in LOCKS)]
    no = [other + plain, other + "see lockfileVersion: in the yarn lockfile, generated by cargo\n" + plain, other + '# says "generated by hand"\n' + plain]
    assert all(len(other) > 400 and "lockfile" in (folding.shape(t) or "") for t in yes)
    assert [folding.shape_generated(t) for t in no] == [None] * len(no)
    df = spark.createDataFrame(list(enumerate(yes + no)), "i int, x string").select("i", X.generated_kind(F.col("x")).alias("k"))
    assert [r.k for r in df.orderBy("i").collect()] == ["lockfile"] * len(yes) + [None] * len(no)


def test_global_fold_merges_any_number_of_buckets():
    """Lines of one template fold as well when they and others fall into over 512 buckets."""
    job = [f"job worker {i} done" for i in (7, 12, 345, 6789, 10234)]
    other = [f"{a}x y{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    out, folded = folding.fold_global("\n".join(job[:2] + other + job[2:]))
    assert folded and out == "\n".join(["job worker {} done [×5: (7) (12) (345) (6789) (10234)]", *other])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.sets(st.sampled_from("abcdefghijklmnop"), min_size=1)), max_size=40), st.sampled_from([0.5, 0.6, 0.75, 0.9, 1.0]))
def test_bucket_merge_equals_all_pairs(given_, share):
    keyed = {(n, i): [i] for i, (n, _) in enumerate(given_)}
    want = []
    for i, (n, mask) in enumerate(given_):
        m = next((m for m in want if m[0] == n and len(m[1] & mask) >= share * len(m[1] | mask)), None)
        if m:
            m[2].append(i)
        else:
            want.append((n, mask, [i]))
    assert folding._merged(keyed, [m for _, m in given_], share) == [m[2] for m in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 9), max_size=4), st.integers(1, 5), st.floats(0, 1)), min_size=1, max_size=10), st.integers(1, 15))
def test_lazy_selection_equals_plain_greedy(items, budget):
    feats, costs, rel = [sorted(f) for f, _, _ in items], [c for _, c, _ in items], [r for _, _, r in items]
    got = selecting.celf(feats, costs, rel, budget)
    assert sum(costs[i] for i in got) <= budget and got == sorted(set(got))
    assert got == plain_greedy(feats, costs, rel, budget)


def plain_greedy(feats, costs, rel, budget, weight=0.5, saturation=0.3):
    """Looks at every item in every round."""
    total = {f: sum(fs.count(f) for fs in feats) for fs in feats for f in fs}
    taken = []
    while True:
        have = {f: sum(feats[i].count(f) for i in taken) for f in total}
        best = None
        for i in range(len(costs)):
            if i in taken or not 0 < costs[i] <= budget - sum(costs[k] for k in taken):
                continue
            cover = sum(min(have[f] + 1, saturation * total[f]) - min(have[f], saturation * total[f]) for f in feats[i])
            gain = (weight * rel[i] + (1 - weight) * cover) / costs[i]
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, i)
        if best is None:
            return sorted(taken)
        taken.append(best[1])


def test_sentences_and_tiles():
    text = "One fish swims. Two cats sleep. Paris is in France! Why? Dogs bark."
    assert "".join(selecting.sentences(text)) == text
    parts = selecting.sentences(text)
    kept = selecting.prune_sentences(parts, ["paris"], 0.4)
    assert 2 in kept and 0 in kept and len(parts) - 1 in kept
    long = " ".join(f"Topic{i // 8} words about thing{i // 8} number {i}." for i in range(40))
    assert "".join(selecting.texttile(long)) == long and "".join(selecting.chunks_of(long)) == long
    assert selecting.u_shape([0, 1, 2, 3, 4]) == [0, 2, 4, 3, 1]
    assert sorted(selecting.textrank(parts)) == list(range(len(parts)))


@settings(max_examples=100, deadline=None)
@given(st.recursive(LEAF, lambda c: st.one_of(st.lists(c, max_size=4), st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=3), c, max_size=4)), max_leaves=12))
def test_json_is_exact(v):
    text = json.dumps(v, ensure_ascii=False, indent=1)
    assert json.loads(J.dumps(J.loads(text))) == v
    if isinstance(v, (dict, list)):
        assert json.loads(J.minify(text)) == v


@settings(max_examples=100, deadline=None)
@given(st.lists(st.fixed_dictionaries({"id": LEAF, "na me": LEAF}), min_size=2, max_size=6))
def test_toon_round_trip(rows):
    v = J.loads(json.dumps(rows))
    assert json.loads(J.dumps(J.from_toon(J.to_toon(v)))) == rows


def test_number_literals_and_routes():
    assert J.minify('{"b": 1.50, "a": 1e5}') == '{"b":1.50,"a":1e5}'
    assert J.encode(J.loads('[{"a":1,"b":{"c":2}},{"a":3,"b":{"c":4}}]'), as_csv=False)[0].startswith("[2]{a,b.c}:")
    assert J.encode(J.loads('[{"a":1},{"a":2},{"b":1},{"b":2}]'))[1] in ("csv", "buckets")
    assert J.encode(J.loads('{"x":[{"a":1},{"a":2}]}'))[1] == "nested" and J.encode(J.loads("[1,2]")) is None


def test_crush_keeps_outliers():
    rows = [{"id": i, "state": "bad" if i == 70 else "ok"} for i in range(100)]
    out, n = J.crush(J.loads(json.dumps(rows)), 20)
    ids = [int(r["id"]) for r in out]
    assert n == 100 and len(ids) == 20 and 70 in ids and ids[0] == 0 and ids[-1] == 99
    assert J.crush(J.loads(json.dumps(rows[:10])), 20) is None


def test_schema_and_base64():
    s = J.minify_schema({"$schema": "x", "title": "t", "type": ["string"], "properties": {"title": {"type": "string", "description": "same"}, "b": {"description": "same"}}})
    assert "$schema" not in s and s["type"] == "string" and "title" in s["properties"] and "description" not in s["properties"]["b"]
    assert J.scrub_base64("a data:image/png;base64,AAAA= b " + "Q" * 300) == "a [base64 elided: 27 chars] b [base64 elided: 300 chars]"


def test_phrases_restore():
    texts = ["the long phrase that repeats here and then again " * 3, "the long phrase that repeats here once more"]
    new, glossary = phrases.mine(texts)
    assert glossary and phrases.restore(new, glossary) == texts
    assert sum(map(lex.estimate, new)) < sum(map(lex.estimate, texts))


def test_skeletons():
    py = "def a(x):\n    y = 1\n    z = y * 2\n    return z\n\ndef find(q):\n    return q\n"
    assert "..." in codetext.skeleton(py, "python", {"find"}, 1) and "return q" in codetext.skeleton(py, "python", {"find"}, 1)
    rs = 'fn a() {\n  let s = "}";\n  work(s);\n  more();\n}\nfn b() { find() }\n'
    out = codetext.skeleton(rs, "rust", {"find"}, 1)
    assert "work" not in out and "find()" in out
    assert codetext.minify("a {\n    b;\n\n    c;\n}", "rust") == "a {\nb;\nc;\n}" and codetext.minify("  x", "python") == "  x"


def test_measures():
    assert C.coverage("paris is nice. rome is old", "rome is old", ["rome"]) < 1.0
    assert C.coverage("a b", "", []) == 1.0 and C.density("a b c d", "b c x") == pytest.approx(1.0)
    assert 0.3 < C.calibrate([(0.2, False), (0.3, False), (0.9, True), (0.8, True)]) < 0.31


BODIES = {
    "openai": {"model": "m", "messages": [{"role": "system", "content": "rules"}, {"role": "user", "content": [{"type": "text", "text": "hi"}]}]},
    "anthropic": {"system": "s", "messages": [{"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "out"}]}]},
    "google": {"contents": [{"role": "user", "parts": [{"text": "hi"}, {"functionResponse": {"name": "f", "response": {"a/b": "leaf"}}}]}]},
}


@pytest.mark.parametrize("provider", BODIES)
def test_segments_can_be_set(provider):
    body = json.loads(json.dumps(BODIES[provider]))
    assert R.detect(body) == provider
    for s in R.segments(body, provider):
        assert R.assign(body, s.ptr, s.text + "!")
    assert [s.text[-1] for s in R.segments(body, provider)] == ["!"] * len(R.segments(body, provider))
    assert not R.assign(body, "/nope/0", "x")
    assert all(b[-1] > 0 for b in R.attribute(body, provider))


def test_cached_prefix_is_frozen():
    body = {"system": "s", "messages": [{"role": "user", "content": [{"type": "text", "text": "a a\na a", "cache_control": {}}]}, {"role": "user", "content": "b"}]}
    assert [s.frozen for s in R.segments(body, "anthropic")] == [True, True, False]


@pytest.mark.parametrize("name", ["safe", "auto", "rag", "agent", "code", "aggressive", "cache", "reasoning", "frugal"])
def test_presets_never_grow_content(name):
    log = "\n".join(f"2024-01-01 10:00:{i % 60:02d} INFO did step {i}" for i in range(120))
    body = {"model": "m", "messages": [{"role": "user", "content": log}, {"role": "user", "content": "what failed?"}]}
    d = C.compress_body(json.dumps(body), name, provider="openai")
    for stage, applied, before, after, _ in d["stages"]:
        assert after == before if not applied else after < before or stage in ("image", "output", "cache")
    assert C.compress_body('{"messages":[]}', "safe", provider="openai")["body"] == '{"messages":[]}'
    with pytest.raises(ValueError):
        C.compress_body('{"messages":[]}', "safe")


def test_image_detail():
    image = {"type": "image_url", "image_url": {"url": "data:image/png;base64,xx", "detail": "high"}}
    body = json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": [image]}]})
    for tier, want in (("", "high"), ("low", "low")):
        d = C.compress_body(body, config=replace(Config(), image=True, image_detail=tier))
        assert json.loads(d["body"])["messages"][1]["content"][0]["image_url"]["detail"] == want


def test_counts_of_unchanged_texts_are_kept(monkeypatch):
    asked = []
    monkeypatch.setattr(C, "estimate", lambda t: asked.append(t) or len(t))
    body = {"messages": [{"role": "system", "content": "s"}, *({"role": "user", "content": f"text {i}"} for i in range(5))]}
    C.compress_body(json.dumps(body), "aggressive")
    assert all(asked.count(f"text {i}") == 1 for i in range(5))


def test_settings():
    assert preset("AUTO").auto and from_table({"preset": "rag", "dedup": False}) == preset("rag")
    with pytest.raises(ValueError):
        from_table({"nope": 1})
    with pytest.raises(KeyError):
        preset("nope")
    assert "no_dedup" in ablations(Config())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.integers(0, 70), st.randoms())
def test_bands_find_the_first_near_fingerprint(base, distance, r):
    prints = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 30))) for b in base for _ in range(4)]
    held = folding.Alike(distance)
    for i, h in enumerate(prints):
        assert held.first(h) == next((k for k, p in enumerate(prints[:i]) if (p ^ h).bit_count() <= distance), None)
        held.add(h, i)

"""File sources, requests as tables, the pipeline over DataFrames, and operators on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from tokenweir.functions import ledger_math as M, text as X
from tokenweir.functions.tokens import bpe_counter, estimate
from tokenweir.operators import evaluate as E, segments as S
from tokenweir.plans import compress as C
from tokenweir.sources import corpora, requests as R


def test_captures_count_torn_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"provider": "openai", "before": "{}", "after": "{}", "input_before": 5}))
    (tmp_path / "b.json").write_text('{"ts": "t')
    got = {r.file: r for r in corpora.captures(spark, str(tmp_path)).collect()}
    assert got["b.json"].skipped and not got["a.json"].skipped and got["a.json"].input_before == 5
    sizes = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "file string, size long")
    assert {r.file for r in corpora.retained(sizes, 10).collect()} == {"b", "c"}


def test_case_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"name":"x","context":"c","question":"q","gold":["a","b"],"scorer":"f1"}\n\n{"prompt":"p","system":"s","gold":"g"}\n')
    rows = corpora.bench_cases(spark, str(tmp_path / "c.jsonl")).collect()
    assert rows[0].gold == ["a", "b"] and json.loads(rows[0].body)["messages"][0]["content"] == "c\n\nq"
    assert rows[1].gold == ["g"] and json.loads(rows[1].body)["messages"][0]["role"] == "system"
    (tmp_path / "r.jsonl").write_text('{"input":"c","query":"q","expected":"e"}\n')
    assert corpora.recall_cases(spark, str(tmp_path / "r.jsonl")).first().answers == ["e"]


def test_transcripts(spark, tmp_path):
    u = lambda n: {"message": {"usage": {"input_tokens": n}}}
    lines = [{"timestamp": "1", **u(5)}, {"timestamp": "3", **u(7)}, {"timestamp": "4"}, {"timestamp": "9", "isSidechain": True, **u(99)}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken {")
    r = corpora.transcript(spark, str(tmp_path / "t.jsonl")).first()
    assert (r.ts, r.tokens) == ("4", 7)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02 00:00:00", 1)], "ts string, n long")
    corpora.export_csv(df, str(tmp_path / "c"))
    corpora.export_json(df, str(tmp_path / "j"))
    corpora.append_ledger(df, str(tmp_path / "l"))
    corpora.append_ledger(df, str(tmp_path / "l"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().n == "1"
    assert spark.read.json(str(tmp_path / "j")).first().n == 1 and spark.read.parquet(str(tmp_path / "l")).count() == 2


def test_compress_tables(spark):
    log = "\n".join(f"INFO step {i}" if i != 30 else "ERROR boom" for i in range(100))
    body = json.dumps({"messages": [{"role": "user", "content": log}, {"role": "user", "content": "what failed"}]})
    df = spark.createDataFrame([(1, body), (2, "not json"), (3, None)], "request_id long, body string")
    got = {r.request_id: r for r in C.compress(df, "agent", provider="openai").collect()}
    assert got[1].tokens_after < got[1].tokens_before and "ERROR boom" in got[1].body
    assert got[2].body == "not json" and got[3].body is None
    untold = C.compress(df, "agent").collect()
    assert all(r.provider is None and r.stages == [] and r.tokens_after == r.tokens_before for r in untold) and untold[0].body is not None
    text = C.compress_text(spark.createDataFrame([(1, "a\na\na\nb")], "id long, text string")).first()
    assert text.text == "a [×3]\nb" or text.text == "a\na\na\nb"
    with pytest.raises(ValueError):
        C.compress(df, "nope")


def test_segments_and_edits(spark):
    df = spark.createDataFrame([(1, '{"system":"s","messages":[{"role":"user","content":"hi","n":1.50}]}')], "request_id long, body string")
    segs = R.extract_segments(df)
    assert [(r.ptr, r.text) for r in segs.orderBy("seg_ix").collect()] == [("/system", "s"), ("/messages/0/content", "hi")]
    out = R.apply_edits(df, segs.withColumn("text", F.upper("text"))).first().body
    assert out == '{"system":"S","messages":[{"role":"user","content":"HI","n":1.50}]}'


def one(spark, *cols, rows=None, schema="x string"):
    return spark.createDataFrame(rows or [("",)], schema).select(*cols)


def test_text_columns(spark):
    rows = [("a\r\nb\n",), ("",), ("\n",), ("x",)]
    got = [r[0] for r in one(spark, X.lines(F.col("x")), rows=rows).collect()]
    assert got == [["a", "b"], [], [""], ["x"]]
    assert [r[0] for r in one(spark, estimate(F.col("x")), rows=[("hello world",), (None,), ("a    b",)]).collect()] == [3, 0, 2]
    assert one(spark, X.subtokens(F.col("x")), rows=[("parseHTTPBody_v2",)]).first()[0] == ["parse", "http", "body", "v2"]
    assert one(spark, X.unicode_normal(F.col("x")), rows=[("a b​c",)]).first()[0] == "a bc"
    got = one(spark, X.standalone(F.col("x"), "run"), rows=[("run it",), ("rerun",), ("run_it",)]).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_labels(spark):
    rows = [("mcp__srv__tool",), ("mcp__",), ("bash",)]
    assert [r[0] for r in one(spark, M.mcp_server(F.col("x")), rows=rows).collect()] == ["srv", None, None]
    assert [r[0] for r in one(spark, M.project_label(F.col("x")), rows=[("/a/b",), (None,), ("/",)]).collect()] == ["b", "(no project)", "(no project)"]
    assert one(spark, M.title_case(F.col("x")), rows=[("my_agent-ONE x",)]).first()[0] == "My Agent ONE X"
    weeks = [("2024-01-01",), ("2023-01-01",), ("2024-12-31",)]
    assert [r[0] for r in one(spark, M.week(F.col("x")), rows=weeks).collect()] == ["2024-W01", "2023-W00", "2024-W53"]


def test_dedup_keeps_untouched_texts(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "a\n\na\n"), (3, "")], "id long, text string")
    assert {r.id: r.text for r in S.dedup_exact(df, ["id"]).collect()} == {1: "a\nb\n", 2: "a [×2]\n", 3: ""}


def test_bpe_counts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    got = [r[0] for r in one(spark, bpe_counter(path)("x"), rows=[("hello world",), ("",), (None,)]).collect()]
    assert got == [2, 0, 0]


def test_answers(spark):
    rows = [("a cat", "The cat!"), ("", ""), ("x y y", "y")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, answer string, gold string")
    assert {r.id: round(r.f1, 6) for r in E.token_f1(df).collect()} == {0: 1.0, 1: 1.0, 2: 0.5}
    assert {r.id: r.rouge_l for r in E.rouge_l(df).collect()} == {0: 1.0, 1: 1.0, 2: 0.5}


def test_names_are_taken_literally(spark):
    """Names with signs of regular expressions, and with a quote end inside."""
    names = ["get.weather", "f(", "a+b", "x\\Ey", "run"]
    rows = [(n, t) for n in names for t in (f"use {n} now", "use getXweather now", f"{n}s" if n[-1].isalnum() else f"say {n}", "")]
    df = spark.createDataFrame(rows, "name string, text string")
    got = df.select("name", "text", X.mentions(F.col("text"), F.col("name")).alias("m")).collect()
    for r in got:
        touched = r["text"].endswith(r["name"] + "s")
        assert r.m == (r["name"] in r["text"] and not touched), r
    assert df.filter(X.standalone(F.col("text"), "f(")).count() == 2


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(4000).selectExpr("id", "id % 2 AS g", "IF(id % 2 = 0, id % 10, 3) AS v", "1 + id % 3 AS w")
    rows = lambda d, **k: sorted((r.g, round(r["mean"], 9), round(r.lo, 9), round(r.hi, 9)) for r in E.bootstrap(d, "g", "v", ["id"], draws=400, **k).collect())
    got = rows(df)
    assert got == rows(df.repartition(7)) == rows(df.coalesce(1))
    (_, mean, lo, hi), (_, same, lo1, hi1) = got
    assert mean == 4.0 and same == 3.0 == lo1 == hi1
    se = 8**0.5 / 2000**0.5
    assert abs(hi - lo - 3.92 * se) < 0.8 * se and lo < mean < hi
    weighted = rows(df, weight="w")
    assert weighted[0][1] == round(df.filter("g = 0").selectExpr("sum(v) / sum(w) AS x").first().x, 9)
    paired = E.paired_bootstrap(df.withColumn("u", F.col("v") + 2), "g", "v", "u", ["id"], draws=100).collect()
    assert all(abs(x - 2) < 1e-9 for r in paired for x in (r["mean"], r.lo, r.hi))


def test_text_in_rows(spark):
    """Lines folded within their row, against plain Python."""
    texts = ["", None, "a", "a\na", "b\na\nb\n\n\na\nb", "x\r\nx\r\ny", " \n \nq\nq", "\n".join(str(i % 50) for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def lines(t):
        ls = t.split("\n")
        return [x.removesuffix("\r") for x in (ls[:-1] if ls[-1] == "" else ls)]

    def mark(x, n):
        return f"{x} [×{n}]" if n > 1 else x

    def exact(t):
        if not t:
            return t
        ls, n = lines(t), {}
        for x in ls:
            n[x] = n.get(x, 0) + 1
        if all(c == 1 or not x.strip(" ") for x, c in n.items()):
            return t
        return "\n".join(mark(x, n[x] if x.strip(" ") else 1) for i, x in enumerate(ls) if not x.strip(" ") or ls.index(x) == i)

    def adjacent(t):
        if not t:
            return t
        out = []
        for x in lines(t):
            if out and out[-1][0] == x and x.strip(" "):
                out[-1][1] += 1
            else:
                out.append([x, 1])
        return "\n".join(mark(x, n) for x, n in out)

    for f, want in ((S.dedup_exact, exact), (S.dedup_adjacent, adjacent)):
        assert {r.id: r["text"] for r in f(df, ["id"]).collect()} == {i: want(t) for i, t in enumerate(texts)}


def test_common_tokens(spark):
    pairs = [("", ""), ("a b", None), (None, None), ("b b c", "b c c d"), ("one two two", "two one two"), ("x", "y")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, answer string, gold string")
    got = {r.id: round(r.f1, 9) for r in E.token_f1(df).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 1.0, 3: round(4 / 7, 9), 4: 1.0, 5: 0.0}


def test_shared_beginnings(spark):
    bodies = ["", "a", "ab", "abc🙂d", "abc🙂e", "abc🙂e", "zzz", None, "zzz"]
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], "g long, pos long, body string")
    got = {r.pos: r.shared for r in E.prefix_stability(df, "g", "pos").collect() if bodies[r.pos] is not None}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 6, 8)] == [0, 0, 1, 2, 4, 5, 0, 0]

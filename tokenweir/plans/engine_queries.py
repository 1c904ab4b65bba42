"""Queries over requests, sequential algorithms, evaluation and file-level operators, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tokenweir.functions import codetext, folding, jsontext as J, phrases, selecting
from tokenweir.functions.lex import words
from tokenweir.operators import evaluate as E
from tokenweir.plans import compress as C
from tokenweir.plans.text_queries import _EST
from tokenweir.sources import corpora, requests as R
from tokenweir.sources.derived import cte, frame
from tokenweir.streaming import responses


def _table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def per_text(f: Callable[[str], str], kind: str = "string"):
    """A sequential text algorithm as an Arrow column function; null texts are empty."""

    @pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([f(t or "") for t in texts])

    return run


def _docs(s, d):
    return _table(s, d, "documents").select("doc_id", "text")


def _requests(s, d):
    return R.from_conversations(_table(s, d, "conversations"))


def _logs(s, d):
    packed = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return frame(s, d, "log_lines").groupBy("seg").agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("text"))


def _arrays(s, d):
    packed = F.sort_array(F.collect_list(F.struct("pos", "record")))
    return frame(s, d, "records").groupBy("arr").agg(F.concat(F.lit("["), F.array_join(F.transform(packed, lambda x: x["record"]), ","), F.lit("]")).alias("text"))


def _compressed(preset):
    return lambda s, d: C.compress(_requests(s, d), preset, provider="openai").select("request_id", "provider", "preset", "tokens_before", "tokens_after", F.size("stages").alias("stages"))


def _encoded(text: str) -> str:
    v = J.parsed(text)
    out = J.encode(v, as_csv=False) if v is not None else None
    return out[0] if out else text


def _csv(text: str) -> str:
    """Records as CSV; what is no JSON stays."""
    v = J.parsed(text)
    return J.to_csv(v) if v is not None else text


def _crushed(text: str) -> str:
    out = J.crush(J.parsed(text), 4)
    return J.dumps(out[0]) if out else text


def _pick(f) -> Callable[[str], str]:
    def run(text: str) -> str:
        parts = selecting.chunks_of(text)
        return ",".join(map(str, f(parts))) if len(parts) > 1 else "0"

    return run


def _celf(parts):
    cost = [max(1, len(words(p))) for p in parts]
    return selecting.celf([selecting.pairs(p) for p in parts], cost, [1 - i / len(parts) for i in range(len(parts))], -(-sum(cost) // 2))


def _mmr(parts):
    return selecting.mmr(list(range(len(parts))), parts, 8)


def _phrases(text: str) -> str:
    new, glossary = phrases.mine(text.split("\n\n"), 32)
    assert phrases.restore(new, glossary) == text.split("\n\n")
    return ";".join(p for _, p in glossary)


def _code(s, d):
    p = _table(s, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("fn part_"), F.col("p_partkey").cast("string"), F.lit("(x: u32) {\n    let size = "), F.col("p_size").cast("string"),
                 F.lit(";\n    let total = size * x + 1;\n    let name = \""), "p_name", F.lit("\";\n    emit(total, name);\n}\n")).alias("code"),
    )
    return p.select("id", per_text(lambda t: codetext.skeleton(t, "rust", {"nothing"}, 0))("code").alias("skeleton"), per_text(lambda t: codetext.minify(t, "rust"))("code").alias("minified"))


def _qa(s, d):
    """A text's lines without its first as the answer, and without its last as the gold."""
    ls = F.split("text", "\n")
    n = F.greatest(F.size(ls) - 1, F.lit(1))
    return _docs(s, d).select(F.col("doc_id").alias("id"), F.array_join(F.slice(ls, 2, n), "\n").alias("answer"), F.array_join(F.slice(ls, 1, n), "\n").alias("gold"))


def _li(s, d):
    return _table(s, d, "lineitem")


def _numbers(s, d):
    li = _li(s, d).select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").alias("n"))
    return li.select("l_orderkey", "l_linenumber", E.numeric_match(F.concat(F.lit("about 7, so 1,"), F.lpad((F.col("q") % 3).cast("string"), 3, "0")), F.concat(F.lit("= 100"), (F.col("n") % 3).cast("string"))).alias("hit"))


def _choices(s, d):
    c = _table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("k"))
    letter = F.substring(F.lit("ABCD"), 1, 4)
    pick = F.element_at(F.split(letter, ""), (F.col("k") + 1).cast("int"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("A) no. The answer is ("), pick, F.lit(")"))).when(F.col("c_custkey") % 3 == 1, F.concat(pick, F.lit("."))).otherwise(F.lit("none of them"))
    return c.select("c_custkey", E.selected_choice(said).alias("choice"), E.choice_match(said, F.lit("b")).alias("hit"))


def _calls(s, d):
    c = _table(s, d, "customer")
    call = F.when(F.col("c_custkey") % 3 == 0, F.lit("I would call get_weather now")).otherwise(
        F.concat(F.lit('{"name":"'), F.when(F.col("c_custkey") % 2 == 0, F.lit("get_weather")).otherwise(F.lit("other")), F.lit('","arguments":{"city":"x"'), F.when(F.col("c_custkey") % 5 == 0, F.lit(',"unit":1')).otherwise(F.lit("")), F.lit("}}"))
    )
    return c.select("c_custkey", E.tool_call_match(call, F.lit("get_weather"), F.array(F.lit("city"))).alias("hit"))


def _outcomes(s, d):
    return frame(s, d, "compressions").select(
        "provider", F.col("input_before").alias("in_before"), F.col("input_after").alias("in_after"),
        (F.col("id") % 2).cast("double").alias("q_before"), (F.col("id") % 4 == 1).cast("double").alias("q_after"),
    )


def _captures(s, d):
    return frame(s, d, "blocks").select(
        F.col("turn_id").alias("capture"), F.col("bucket").alias("kind"), F.when(F.col("bucket") == "schema", F.col("tool_name")).alias("tool"),
        F.col("raw_tokens").alias("tokens_before"), (F.col("raw_tokens") - F.col("raw_tokens") % 7).alias("tokens_after"),
    )


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _senders(s, d):
    """Requests of three wire formats whose system texts name agents, directories, both or nothing."""
    c = _table(s, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_name").alias("n"), (F.col("c_custkey") % 4).alias("k"), (F.col("c_custkey") % 3).alias("f"))
    who = F.when(F.col("k") == 0, F.lit("You are Codex at work.")).when(F.col("k") == 1, F.lit("You are Cline, not You are Codex.")).otherwise(F.lit("Just be brief."))
    where = F.when(F.col("k") == 2, F.concat(F.lit("x\n  cwd: `/home/"), "n", F.lit("`  \nWorking directory: /late"))).otherwise(F.lit("cwd:  "))
    text = F.concat(who, F.lit("\n"), where)
    hello = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    system = F.array(F.struct(F.lit("system").alias("role"), text.alias("content")))
    body = (
        F.when(F.col("f") == 0, F.to_json(F.struct(text.alias("system"), hello.alias("messages"))))
        .when(F.col("f") == 1, F.to_json(F.struct(F.concat(system, hello).alias("messages"))))
        .otherwise(F.to_json(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("systemInstruction"), F.array().cast("array<string>").alias("contents"))))
    )
    return c.select("request_id", body.alias("body"))


def _usage(s, d):
    e = _table(s, d, "events").select("event_id", (F.col("event_id") % 3).alias("k"), (F.col("event_id") % 50).alias("a"), (F.col("event_id") % 20).alias("b"))
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    body = (
        F.when(F.col("k") == 0, F.concat(F.lit('{"usage":{"input_tokens":'), a, F.lit(',"cache_read_input_tokens":'), b, F.lit(',"output_tokens":3}}')))
        .when(F.col("k") == 1, F.concat(F.lit('{"usage":{"prompt_tokens":'), a, F.lit(',"prompt_tokens_details":{"cached_tokens":'), b, F.lit('},"completion_tokens":4}}')))
        .otherwise(F.concat(F.lit('{"usageMetadata":{"promptTokenCount":'), a, F.lit(',"cachedContentTokenCount":'), b, F.lit("}}")))
    )
    return e.select("event_id", *[c.alias(n) for n, c in responses.usage_columns(body).items()])


def _facts(s, d):
    reg = s.createDataFrame([("m0", 1000, None, None), ("m1-2024", 2000, 7.0, True), ("m1-2025", 3000, 9.0, False), ("m2", 4000, 5.0, False)], "id string, context long, rating double, reasoning boolean")
    rows = frame(s, d, "compressions").select("id", F.concat(F.lit("Acme/"), F.upper("model")).alias("model"))
    return corpora.model_facts(rows.withColumnRenamed("id", "row_id"), reg)


def _images(s, d):
    p = _table(s, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 4000 + 1).cast("int").alias("w"), (F.col("p_partkey") * 91 % 3000 + 1).cast("int").alias("h"))
    out = p.select("p_partkey", *[corpora.image_target(F.col("w"), F.col("h"), *caps).alias(k) for k, caps in corpora.IMAGE_CAPS.items()])
    return out.select("p_partkey", *[F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in corpora.IMAGE_CAPS for x in ("width", "height")])


def _stability(s, d):
    c = _table(s, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(":"), F.coalesce("text", F.lit(""))).alias("body"))
    return E.prefix_stability(c, "conv_id", "turn")


def _idle(s, d):
    t = frame(s, d, "turns").select(F.col("agent").alias("session"), "ts", (F.col("fresh_input") + F.col("cache_read")).alias("tokens"))
    return responses.idle_gaps(t.groupBy("session", "ts").agg(F.max("tokens").alias("tokens")), 300, 400)


QUERIES = {
    "provider_detect": lambda s, d: _requests(s, d).select("request_id", R.provider_column(F.col("body")).alias("provider")),
    "extract_segments": lambda s, d: R.extract_segments(_requests(s, d)).select("request_id", "seg_ix", "ptr", "role", "instruction", "text"),
    "apply_edits": lambda s, d: R.extract_segments(R.apply_edits(_requests(s, d), R.extract_segments(_requests(s, d)).filter("role = 'user'").select("request_id", "ptr", F.reverse("text").alias("text")))).select("request_id", "ptr", "text"),
    "attribute_blocks": lambda s, d: R.attribute_blocks(_requests(s, d)).select("request_id", "section", "bucket", "role", "msg_index", "tokens"),
    "compress_safe": _compressed("safe"),
    "compress_auto": _compressed("auto"),
    "compress_aggressive": _compressed("aggressive"),
    "stage_report": lambda s, d: C.stage_report(C.compress(_requests(s, d), "auto", provider="openai")),
    "toon_encode": lambda s, d: _arrays(s, d).select("arr", per_text(_encoded)("text").alias("table")),
    "csv_union": lambda s, d: _arrays(s, d).select("arr", per_text(_csv)("text").alias("table")),
    "json_crush": lambda s, d: _arrays(s, d).select("arr", per_text(_crushed)("text").alias("sample")),
    "json_minify": lambda s, d: _arrays(s, d).select("arr", per_text(lambda t: J.minify(t.replace(",", " , ").replace(":", " : ")))("text").alias("text")),
    "global_fold": lambda s, d: _logs(s, d).select("seg", per_text(lambda t: folding.fold_global(t)[0])("text").alias("text")),
    "shape_output": lambda s, d: _logs(s, d).select("seg", per_text(lambda t: folding.shape(t, set(), 4, 8) or t)("text").alias("text")),
    "dedup_near": lambda s, d: _docs(s, d).select("doc_id", per_text(lambda t: folding.dedup(t, True))("text").alias("text")),
    "celf_select": lambda s, d: _docs(s, d).select("doc_id", per_text(_pick(_celf))("text").alias("kept")),
    "mmr_order": lambda s, d: _docs(s, d).select("doc_id", per_text(_pick(_mmr))("text").alias("kept")),
    "textrank": lambda s, d: _docs(s, d).select("doc_id", per_text(_pick(lambda p: selecting.textrank(p)[:8]))("text").alias("best")),
    "texttile": lambda s, d: _docs(s, d).select("doc_id", per_text(lambda t: len(selecting.texttile(t)), "long")("text").alias("tiles")),
    "ngram_mine": lambda s, d: _docs(s, d).select("doc_id", per_text(_phrases)("text").alias("phrases")),
    "density": lambda s, d: _docs(s, d).select("doc_id", F.round(per_text(lambda t: C.density(t, " ".join(t.split()[::-1]) + t), "double")("text"), 6).alias("density")),
    "skeleton": _code,
    "token_f1": lambda s, d: _rounded(E.token_f1(_qa(s, d)), "f1"),
    "span_match": lambda s, d: _qa(s, d).select("id", E.span_match(F.col("answer"), F.col("gold")).alias("hit")),
    "contains_match": lambda s, d: _qa(s, d).select("id", E.contains_match(F.col("answer"), F.col("gold")).alias("hit")),
    "rouge_l": lambda s, d: _rounded(E.rouge_l(_qa(s, d)), "rouge_l"),
    "numeric_match": _numbers,
    "choice_match": _choices,
    "tool_call_match": _calls,
    "recall": lambda s, d: _rounded(_docs(s, d).select("doc_id", E.recall(F.expr("substr(text, 1, length(text) div 2)"), F.filter(F.split("text", r"\. "), lambda p: F.length(p) > 20)).alias("recall")), "recall"),
    "frontier": lambda s, d: _rounded(E.frontier(_outcomes(s, d), "provider"), "q_before", "q_after", "retention", "saved_pct"),
    "mean_ci": lambda s, d: _rounded(E.mean_ci(_li(s, d), "l_returnflag", "l_quantity"), "mean", "half_width"),
    "percentiles": lambda s, d: _rounded(E.percentiles(_li(s, d), "l_returnflag", "l_extendedprice"), "p50", "p95"),
    "bootstrap_ci": lambda s, d: E.bootstrap(_li(s, d), "l_returnflag", "l_quantity", ["l_orderkey", "l_linenumber"], draws=1000),
    "cached_cost": lambda s, d: _rounded(frame(s, d, "turns").select("id", E.cached_cost(F.col("fresh_input"), F.col("cache_read"), F.col("output_tok"), 3.0, 0.3, 15.0).alias("usd")), "usd"),
    "residual_report": lambda s, d: _rounded(E.residual(_captures(s, d)), "share_pct", "compressed_pct"),
    "prefix_stability": _stability,
    "usage_extract": _usage,
    "request_identity": lambda s, d: R.identities(_senders(s, d)).select("request_id", "agent", "project", "session_id"),
    "model_facts": _facts,
    "image_target": _images,
    "idle_gaps": _idle,
    "windowed_usage": lambda s, d: responses.windowed_usage(_table(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 6).alias("total")),
}

_NORM = r"list_filter(string_split(regexp_replace(regexp_replace(lower(COL), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
_QA = "WITH qa AS (SELECT doc_id AS id, array_to_string(list_slice(string_split(text, chr(10)), 2, len(string_split(text, chr(10)))), chr(10)) AS answer, array_to_string(list_slice(string_split(text, chr(10)), 1, greatest(len(string_split(text, chr(10))) - 1, 1)), chr(10)) AS gold FROM documents),\n" + (
    f"nm AS (SELECT id, answer, gold, {_NORM.replace('COL', 'answer')} AS a, {_NORM.replace('COL', 'gold')} AS g FROM qa)\n"
)
_TURN = "SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ix, role, coalesce(text, '') AS text FROM conversations"


def _image_sql() -> str:
    out = []
    for k, (long, short, pixels, tile) in corpora.IMAGE_CAPS.items():
        r = [f"{float(long)} / greatest(w, h)"] + ([f"{float(short)} / least(w, h)"] if short else []) + ([f"sqrt({float(pixels)} / (w * h))"] if pixels else [])
        for side, c in (("width", "w"), ("height", "h")):
            v = f"greatest(CAST(floor({c} * least(1.0, {', '.join(r)})) AS INTEGER), 1)"
            out.append(f"{f'CASE WHEN {v} > {tile} AND {v} % {tile} < {tile // 10} THEN {v} - {v} % {tile} ELSE {v} END' if tile else v} AS {k}_{side}")
    return f"WITH p AS (SELECT p_partkey, CAST(p_partkey * 37 % 4000 + 1 AS INTEGER) AS w, CAST(p_partkey * 91 % 3000 + 1 AS INTEGER) AS h FROM part) SELECT p_partkey, {', '.join(out)} FROM p"


_T = " ".join(f"WHEN {k + 1} THEN {v}" for k, v in E.T975.items())
ORACLES = {
    "provider_detect": "SELECT conv_id AS request_id, CASE WHEN bool_or(role = 'system') THEN 'openai' END AS provider FROM conversations GROUP BY conv_id",
    "extract_segments": f"SELECT request_id, ix AS seg_ix, '/messages/' || ix || '/content' AS ptr, role, role IN ('system', 'developer') AS instruction, text FROM ({_TURN})",
    "apply_edits": f"SELECT request_id, '/messages/' || ix || '/content' AS ptr, CASE WHEN role = 'user' THEN reverse(text) ELSE text END AS text FROM ({_TURN})",
    "attribute_blocks": f"""WITH b AS (SELECT *, {_EST} AS tokens FROM ({_TURN}))
SELECT request_id, CASE WHEN role = 'system' THEN 'static' ELSE 'messages' END AS section, CASE WHEN role = 'system' THEN 'system' ELSE 'text' END AS bucket,
  CASE WHEN role <> 'system' THEN role END AS role, CASE WHEN role <> 'system' THEN ix END AS msg_index, tokens FROM b WHERE tokens > 0""",
    "csv_union": cte("records") + r""", v AS (SELECT arr, pos, json_extract_string(record, '$.id') AS id, json_extract_string(record, '$.name') AS name, json_extract_string(record, '$.nation') AS nation, coalesce(json_extract_string(record, '$.note'), '') AS note FROM records),
f AS (SELECT arr, bool_or(note <> '') AS noted, bool_and(note <> '') AS all_noted FROM v GROUP BY arr)
SELECT v.arr, 'id,name,nation' || CASE WHEN noted THEN ',note' ELSE '' END || chr(10) || string_agg(id || ',' || name || ',' || nation || CASE WHEN noted THEN ',' || note ELSE '' END, chr(10) ORDER BY pos) AS table FROM v JOIN f ON v.arr = f.arr GROUP BY v.arr, noted""",
    "toon_encode": cte("records") + r""", v AS (SELECT arr, pos, record, json_extract_string(record, '$.id') || ',' || json_extract_string(record, '$.name') || ',' || json_extract_string(record, '$.nation') AS cells, json_extract_string(record, '$.note') AS note FROM records),
g AS (SELECT arr, count(*) AS n, count(note) AS m FROM v GROUP BY arr)
SELECT v.arr, CASE WHEN n < 2 THEN '[' || string_agg(record, ',' ORDER BY pos) || ']' WHEN m = 0 THEN '[' || n || ']{id,name,nation}:' || string_agg(chr(10) || '  ' || cells, '' ORDER BY pos)
  WHEN m = n THEN '[' || n || ']{id,name,nation,note}:' || string_agg(chr(10) || '  ' || cells || ',' || note, '' ORDER BY pos) ELSE 'id,name,nation,note' || string_agg(chr(10) || cells || ',' || coalesce(note, ''), '' ORDER BY pos) END AS "table"
FROM v JOIN g ON v.arr = g.arr GROUP BY v.arr, n, m""",
    "skeleton": r"""SELECT p_partkey AS id, 'fn part_' || p_partkey || '(x: u32) { /* … */ }' || chr(10) AS skeleton, concat('fn part_', p_partkey, '(x: u32) {', chr(10), 'let size = ', p_size, ';', chr(10),
  'let total = size * x + 1;', chr(10), 'let name = "', p_name, '";', chr(10), 'emit(total, name);', chr(10), '}', chr(10)) AS minified FROM part""",
    "json_minify": cte("records") + "SELECT arr, '[' || string_agg(record, ',' ORDER BY pos) || ']' AS text FROM records GROUP BY arr",
    "token_f1": _QA + """, ta AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(a) AS w FROM nm) GROUP BY id, w), tg AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(g) AS w FROM nm) GROUP BY id, w),
cm AS (SELECT ta.id, sum(least(ta.c, tg.c)) AS n FROM ta JOIN tg ON ta.id = tg.id AND ta.w = tg.w GROUP BY ta.id)
SELECT nm.id, round(CASE WHEN len(a) = 0 AND len(g) = 0 THEN 1.0 WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE 2.0 * n / (len(a) + len(g)) END, 6) AS f1 FROM nm LEFT JOIN cm ON nm.id = cm.id""",
    "span_match": _QA + "SELECT id, CASE WHEN len(g) = 0 THEN len(a) = 0 ELSE contains(' ' || array_to_string(a, ' ') || ' ', ' ' || array_to_string(g, ' ') || ' ') END AS hit FROM nm",
    "contains_match": _QA + "SELECT id, contains(answer, gold) AS hit FROM nm",
    "numeric_match": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 3 = l_linenumber % 3 AS hit FROM lineitem",
    "choice_match": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN substr('ABCD', CAST(c_custkey % 4 + 1 AS INTEGER), 1) END AS choice, coalesce(c_custkey % 3 < 2 AND c_custkey % 4 = 1, FALSE) AS hit FROM customer",
    "tool_call_match": "SELECT c_custkey, c_custkey % 3 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 5 <> 0) AS hit FROM customer",
    "recall": r"""WITH p AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS k, list_filter(string_split(text, '. '), lambda x: length(x) > 20) AS ps FROM documents),
u AS (SELECT doc_id, k, unnest(ps) AS x FROM p), c AS (SELECT doc_id, count(*) FILTER (WHERE contains(k, x)) * 1.0 / count(*) AS r FROM u GROUP BY doc_id)
SELECT p.doc_id, round(coalesce(r, 1.0), 6) AS recall FROM p LEFT JOIN c ON p.doc_id = c.doc_id""",
    "frontier": cte("compressions") + """, o AS (SELECT provider, input_before AS ib, input_after AS ia, CAST(id % 2 AS DOUBLE) AS qb, CASE WHEN id % 4 = 1 THEN 1.0 ELSE 0.0 END AS qa FROM compressions)
SELECT provider, count(*) AS cases, CAST(sum(ib) AS BIGINT) AS in_before, CAST(sum(ia) AS BIGINT) AS in_after, round(avg(qb), 6) AS q_before, round(avg(qa), 6) AS q_after,
  round(avg(CASE WHEN qb > 0 THEN qa / qb END), 6) AS retention, round(CAST(sum(ib) - sum(ia) AS DOUBLE) * 100.0 / sum(ib), 6) AS saved_pct FROM o GROUP BY provider""",
    "mean_ci": f"SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(CASE count(*) {_T} ELSE 1.96 END * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS half_width FROM lineitem GROUP BY l_returnflag",
    "percentiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag",
    "cached_cost": cte("turns") + "SELECT id, round(((fresh_input - least(cache_read, fresh_input)) * 3.0 + least(cache_read, fresh_input) * 0.3 + output_tok * 15.0) / 1000.0, 6) AS usd FROM turns",
    "residual_report": cte("turns", "blocks") + """, c AS (SELECT turn_id AS capture, bucket AS kind, CASE WHEN bucket = 'schema' THEN tool_name END AS tool, raw_tokens AS b, raw_tokens - raw_tokens % 7 AS a FROM blocks),
g AS (SELECT kind, tool, CAST(sum(a) AS BIGINT) AS residual, CAST(sum(b) AS BIGINT) AS before, count(DISTINCT capture) AS captures FROM c GROUP BY kind, tool)
SELECT *, round(residual * 100.0 / sum(residual) OVER (), 6) AS share_pct, round((before - residual) * 100.0 / before, 6) AS compressed_pct FROM g""",
    "usage_extract": """WITH e AS (SELECT event_id, event_id % 3 AS k, event_id % 50 AS a, event_id % 20 AS b FROM events)
SELECT event_id, CASE WHEN k = 0 THEN a ELSE greatest(a - b, 0) END AS fresh_input, b AS cache_read, 0 AS cache_write, CASE k WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 0 END AS output FROM e""",
    "request_identity": r"""WITH RECURSIVE t AS (SELECT c_custkey AS request_id, c_custkey % 4 AS k, (CASE c_custkey % 4 WHEN 0 THEN 'You are Codex at work.' WHEN 1 THEN 'You are Cline, not You are Codex.' ELSE 'Just be brief.' END
    || chr(10) || CASE WHEN c_custkey % 4 = 2 THEN 'x' || chr(10) || '  cwd: `/home/' || c_name || '`  ' || chr(10) || 'Working directory: /late' ELSE 'cwd:  ' END || chr(10)) AS s, c_name FROM customer),
u AS (SELECT DISTINCT s FROM t),
h AS (SELECT s, 0 AS i, 14695981039346656037::HUGEINT AS v FROM u UNION ALL
  SELECT s, i + 1, (xor(v, ascii(substr(s, i + 1, 1))::HUGEINT) * 435 + (xor(v, ascii(substr(s, i + 1, 1))::HUGEINT) % 16777216) * 1099511627776) % 18446744073709551616::HUGEINT FROM h WHERE i < length(s))
SELECT request_id, CASE k WHEN 0 THEN 'codex' WHEN 1 THEN 'codex' END AS agent, CASE WHEN k = 2 THEN '/home/' || c_name END AS project, lpad(lower(to_base((v // 4294967296)::BIGINT, 16)), 8, '0') || lpad(lower(to_base((v % 4294967296)::BIGINT, 16)), 8, '0') AS session_id
FROM t JOIN (SELECT s, v::HUGEINT AS v FROM h WHERE i = length(s)) h ON h.s = t.s""",
    "model_facts": cte("compressions") + """SELECT id AS row_id, 'Acme/' || upper(model) AS model, CAST(CASE model WHEN 'm0' THEN 1000 WHEN 'm2' THEN 4000 END AS BIGINT) AS context,
  CASE model WHEN 'm1' THEN 9.0 WHEN 'm2' THEN 5.0 END AS rating, coalesce(model = 'm1', FALSE) AS reasoning FROM compressions""",
    "image_target": _image_sql(),
    "prefix_stability": """WITH b AS (SELECT conv_id, turn, role || ':' || coalesce(text, '') AS body FROM conversations),
p AS (SELECT *, lag(body) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM b)
SELECT conv_id, turn, length(body) AS chars, CAST(CASE WHEN prev IS NULL THEN 0 ELSE list_max(list_filter(range(0, least(length(body), length(prev)) + 1), lambda i: left(body, i) = left(prev, i))) END AS BIGINT) AS shared FROM p""",
    "idle_gaps": cte("turns") + """, t AS (SELECT agent AS session, ts, max(fresh_input + cache_read) AS tokens FROM turns GROUP BY agent, ts),
g AS (SELECT *, date_diff('second', CAST(lag(ts) OVER (PARTITION BY session ORDER BY ts) AS TIMESTAMP), CAST(ts AS TIMESTAMP)) AS gap FROM t) SELECT * FROM g WHERE gap > 300 AND tokens >= 400""",
    "windowed_usage": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
}

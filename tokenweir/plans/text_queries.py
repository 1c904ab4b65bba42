"""Text, segment and ranking queries of the catalog with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenweir.functions import text as X
from tokenweir.functions.tokens import LETTER, SPACE, estimate
from tokenweir.operators import ranking as R, segments as S
from tokenweir.sources.derived import cte, frame


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _table(spark, d, "documents").select("doc_id", "text")


def _conv(spark, d):
    return S.conversation_segments(_table(spark, d, "conversations"))


def _log(spark, d):
    return frame(spark, d, "log_lines")


def _log_text(spark, d):
    packed = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return _log(spark, d).groupBy("seg").agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("text"))


def _chunks(spark, d):
    """Lines of documents as chunks; the query of a document is its first line's words."""
    ls = S.exploded(_docs(spark, d), ["doc_id"]).withColumnRenamed("line", "text")
    query = ls.filter("pos = 0").select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))
    return ls, query


def _bm25(spark, d):
    ls, query = _chunks(spark, d)
    return R.bm25(ls, "doc_id", "pos", query)


def _line_scores(spark, d):
    one = R.bm25_lines(_docs(spark, d), "doc_id").select("doc_id", F.explode("chunks").alias("c"))
    return one.select("doc_id", F.col("c.pos").alias("pos"), F.round("c.score", 9).alias("score"))


def _tools(spark, d):
    p = _table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("tool"), F.col("p_name").alias("name"), F.col("p_type").alias("params"), F.concat_ws(" ", "p_brand", "p_type").alias("description"))


def _coverage(spark, d):
    a = _conv(spark, d)
    q = S.question(a)
    src = a.join(q, "request_id").filter("seg_ix <> q_ix and role = 'assistant'")
    kept = F.substring_index("text", "\n", 1)
    return src.select("request_id", "seg_ix", F.round(S.coverage(F.col("text"), kept, F.col("query")), 9).alias("coverage"))


def _keep_flag(spark, d):
    return S.errors_only(_log(spark, d), ["seg"])


def _chain_reuse(spark, d):
    chain = S.prefix_hash_chain(_conv(spark, d))
    return S.known_prefix(chain, chain.filter("seg_ix <= 2"))


#: Documents in forms that reach every branch, as both dialects can say them.
_SHAPES = """CASE doc_id % 6 WHEN 1 THEN replace(text, ' ', ',') WHEN 2 THEN concat('{"id":', doc_id, ',"rest":[1,2]}') WHEN 3 THEN replace(replace(text, 'e', '#'), 'n', '%')
  WHEN 4 THEN concat('a: ', replace(text, ' ', chr(10) || 'key = ')) WHEN 5 THEN concat('[{"a":1},{"a":', doc_id) ELSE text END"""
_FILES = """CASE doc_id % 6 WHEN 1 THEN concat('some output', chr(10), '  # yarn lockfile v1', chr(10), text) WHEN 2 THEN replace(replace(text, chr(10), ''), ' ', '(x,y);')
  WHEN 3 THEN replace(text, ' ', chr(10) || 'version = ') WHEN 4 THEN concat('#', replace(replace(replace(replace(text, chr(10), ''), ' ', ''), '.', ''), ',', '')) WHEN 5 THEN concat('{"lockfileVersion": 3,', text) ELSE text END"""

QUERIES = {
    "token_estimate": lambda s, d: _docs(s, d).select("doc_id", estimate(F.col("text")).alias("tokens")),
    "segment_roles": lambda s, d: _conv(s, d).groupBy("role").agg(F.count("*").alias("segments"), F.sum(estimate(F.col("text"))).alias("tokens")),
    "dedup_exact": lambda s, d: S.dedup_exact(_docs(s, d), ["doc_id"]),
    "dedup_adjacent": lambda s, d: S.dedup_adjacent(_docs(s, d), ["doc_id"]),
    "compress_report": lambda s, d: S.compress_report(_table(s, d, "conversations")),
    "output_kind": lambda s, d: _log_text(s, d).select("seg", X.output_kind(F.col("text")).alias("kind")),
    "line_priority": lambda s, d: _log(s, d).select("seg", "pos", X.priority(F.col("line")).alias("priority"), X.query_bonus(F.col("line"), F.array(F.lit("purchase"), F.lit("value"), F.lit("click"))).alias("bonus")),
    "level_census": lambda s, d: S.level_census(_log(s, d), ["seg"]),
    "errors_only": lambda s, d: _keep_flag(s, d).select("seg", "pos", "keep"),
    "elide_runs": lambda s, d: S.elided(_keep_flag(s, d), ["seg"]),
    "template_mask": lambda s, d: _log(s, d).groupBy(X.template(F.col("line")).alias("template")).agg(F.count("*").alias("n")),
    "template_fold": lambda s, d: S.template_fold(_log(s, d), ["seg"]),
    "grep_first_per_file": lambda s, d: S.first_per_file(frame(s, d, "grep_lines"), ["seg"]),
    "top_lines": lambda s, d: S.top_lines(_log(s, d), ["seg"], 8),
    "route_preset": lambda s, d: S.route_preset(_conv(s, d)),
    "frozen_prefix": lambda s, d: S.frozen_prefix(_conv(s, d), F.length("text") > 300).select("request_id", "seg_ix", "frozen"),
    "question_terms": lambda s, d: S.question(_conv(s, d)).select("request_id", "q_ix", F.array_join(F.array_sort("query"), " ").alias("query")),
    "structured_segment": lambda s, d: _docs(s, d).select("doc_id", X.structured(F.expr(_SHAPES.replace("concat(", "concat_ws('', "))).alias("structured")),
    "terminal_normal": lambda s, d: _log(s, d).select("seg", "pos", X.terminal_normal(F.concat(F.lit("10%\r50%\r\x1b[32m"), "line", F.lit("\x1b[0m\r\nend"))).alias("text")),
    "answer_normal": lambda s, d: _docs(s, d).select("doc_id", X.answer_normal(F.col("text")).alias("answer")),
    "generated_kind": lambda s, d: _docs(s, d).select("doc_id", X.generated_kind(F.expr(_FILES)).alias("kind")),
    "significant": lambda s, d: _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.significant(F.col("l_extendedprice")), 6).alias("v")),
    "bm25_rank": lambda s, d: R.best_lines(R.bm25_lines(_docs(s, d), "doc_id"), "doc_id", 5),
    "bm25_chunks": lambda s, d: R.ranked(_bm25(s, d).withColumn("score", F.round("score", 9)), "doc_id", "pos", 5).select("doc_id", "pos", "score", "rank"),
    "feedback_terms": lambda s, d: R.feedback_terms(_chunks(s, d)[0], _line_scores(s, d), "doc_id", "pos").select("doc_id", "term", "rank"),
    "bm25f_tools": lambda s, d: R.bm25f(_tools(s, d), ["promo", "steel", "brand", "part", "12"]).withColumn("score", F.round("score", 9)),
    "coverage": _coverage,
    "bigram_curve": lambda s, d: R.bigram_curve(_log(s, d).withColumnRenamed("line", "text"), "seg", "pos"),
    "knee": lambda s, d: R.knee(R.bigram_curve(_log(s, d).withColumnRenamed("line", "text"), "seg", "pos"), "seg", "pos"),
    "prefix_hash": lambda s, d: S.prefix_hash_chain(_conv(s, d)),
    "known_prefix": _chain_reuse,
    "rare_rows": lambda s, d: R.term_profile(_table(s, d, "orders").select(F.col("o_custkey").cast("long").alias("g0"), (F.col("o_custkey") % 50).cast("long").alias("g"), F.col("o_orderkey").alias("pos"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("v")), "g", "pos", "v"),
}


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_EST = rf"""CAST(floor((coalesce(list_sum(list_transform(regexp_extract_all(text, '[{LETTER}]+'), lambda x: (length(x) + 3) // 4)), 0)
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '[{SPACE}]+'), lambda x: (length(x) + 2) // 4)), 0)
  + len(regexp_extract_all(text, '[^{LETTER}{SPACE}]'))) * 0.72 + 0.5) AS BIGINT)"""
_SOLID = r"list_filter(regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n'), lambda x: trim(x, ' ') <> '')"
_STRONG, _WARN, _LEVEL, _VAR = map(_sq, (X.STRONG, X.WARN, X.LEVEL, X.VARIABLE))
_LINES = r"""CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(regexp_replace(text, '\r?\n\z', ''), '\r\n', chr(10), 'g'), chr(10)) END"""


def _lines_of(table: str, key: str) -> str:
    return f"""ll AS (SELECT {key}, {_LINES} AS l FROM {table}),
ln AS (SELECT {key}, pos, l[pos + 1] AS line FROM (SELECT {key}, l, unnest(range(0, len(l))) AS pos FROM ll))"""


_LOG = cte("log_lines")
_PRI = f"CASE WHEN regexp_matches(line, {_STRONG}) THEN 1.0 WHEN regexp_matches(line, {_WARN}) THEN 0.6 WHEN line LIKE ' %' THEN 0.5 ELSE 0.3 END"
_TPL = rf"regexp_replace(regexp_replace(line, {_VAR}, '{{}}', 'g'), '\s+', ' ', 'g')"
_KEEP = _LOG + f", k AS (SELECT seg, pos, line, regexp_matches(line, {_STRONG}) AS keep FROM log_lines)\n"
_SEGS = "sg AS (SELECT conv_id AS request_id, turn AS seg_ix, role, role IN ('system', 'developer') AS instruction, coalesce(text, '') AS text FROM conversations)"
_DEDUP = f"""gr AS (SELECT K, line, CASE WHEN trim(line) = '' THEN pos END AS own, min(pos) AS pos, count(*) AS n FROM ln GROUP BY K, line, own),
fo AS (SELECT K, string_agg(CASE WHEN n > 1 THEN line || ' [×' || n || ']' ELSE line END, chr(10) ORDER BY pos) AS folded, max(n) AS most FROM gr GROUP BY K)"""
_WORDS = r"regexp_extract_all(lower(TEXT), '[\p{L}\p{N}_]+')"


def _words(col: str) -> str:
    return _WORDS.replace("TEXT", col)


_CHUNKS = f"""WITH {_lines_of('documents', 'doc_id')},
wl AS (SELECT doc_id, pos, {_words('line')} AS ws FROM ln),
tm AS (SELECT doc_id, pos, len(ws) AS dl, unnest(ws) AS term FROM wl),
tf AS (SELECT doc_id, pos, dl, term, count(*) AS tf FROM tm GROUP BY ALL),
qt AS (SELECT DISTINCT doc_id, term FROM tm WHERE pos = 0),
st AS (SELECT doc_id, count(*) AS n, avg(len(ws)) AS avgdl FROM wl GROUP BY doc_id),
ht AS (SELECT tf.* FROM tf JOIN qt ON tf.doc_id = qt.doc_id AND tf.term = qt.term),
df AS (SELECT doc_id, term, count(*) AS df FROM ht GROUP BY doc_id, term),
sc AS (SELECT ht.doc_id, ht.pos, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) + 1.0)), 9) AS score
  FROM ht JOIN df ON ht.doc_id = df.doc_id AND ht.term = df.term JOIN st ON ht.doc_id = st.doc_id GROUP BY ht.doc_id, ht.pos),
bm AS (SELECT wl.doc_id, wl.pos, coalesce(score, 0.0) AS score FROM wl LEFT JOIN sc ON wl.doc_id = sc.doc_id AND wl.pos = sc.pos)
"""
_CURVE = _LOG + f""", wl AS (SELECT seg, pos, {_words('line')} AS ws FROM log_lines),
pr AS (SELECT seg, pos, ws[i] || ' ' || ws[i + 1] AS p FROM (SELECT seg, pos, ws, unnest(range(1, len(ws))) AS i FROM wl)),
fi AS (SELECT seg, p, min(pos) AS pos FROM pr GROUP BY seg, p),
nw AS (SELECT seg, pos, count(*) AS new FROM fi GROUP BY seg, pos),
cu AS (SELECT wl.seg, wl.pos, CAST(sum(coalesce(new, 0)) OVER (PARTITION BY wl.seg ORDER BY wl.pos) AS BIGINT) AS seen FROM wl LEFT JOIN nw ON wl.seg = nw.seg AND wl.pos = nw.pos)
"""
_CHAIN = f"""WITH RECURSIVE {_SEGS},
tn AS (SELECT request_id, seg_ix, sha256(role || chr(1) || text) AS one, row_number() OVER (PARTITION BY request_id ORDER BY seg_ix) AS nr FROM sg),
cr AS (SELECT request_id, seg_ix, nr, sha256(one) AS prefix FROM tn WHERE nr = 1
  UNION ALL SELECT tn.request_id, tn.seg_ix, tn.nr, sha256(cr.prefix || tn.one) FROM cr JOIN tn ON tn.request_id = cr.request_id AND tn.nr = cr.nr + 1),
ch AS (SELECT request_id, seg_ix, prefix FROM cr)
"""
_TOOLF = f"""WITH tl AS (SELECT p_partkey AS tool, p_name AS name, p_type AS params, p_brand || ' ' || p_type AS description FROM part),
fd AS (SELECT tool, 'name' AS f, 4.0 AS w, {_words("replace(name, '_', ' ')")} AS ws FROM tl UNION ALL SELECT tool, 'params', 2.0, {_words("replace(params, '_', ' ')")} FROM tl
  UNION ALL SELECT tool, 'description', 1.0, {_words("replace(description, '_', ' ')")} FROM tl),
av AS (SELECT f, avg(len(ws)) AS a FROM fd GROUP BY f),
tm AS (SELECT tool, f, w, len(ws) AS len, unnest(ws) AS term FROM fd),
tf AS (SELECT tool, tm.f, w, len, term, count(*) AS tf FROM tm WHERE term IN ('promo', 'steel', 'brand', 'part', '12') GROUP BY ALL),
wt AS (SELECT tool, term, sum(w * tf / (0.25 + 0.75 * len / a)) AS tfw FROM tf JOIN av ON tf.f = av.f GROUP BY tool, term),
df AS (SELECT term, count(*) AS df FROM wt GROUP BY term), n AS (SELECT count(*) AS n FROM tl),
sc AS (SELECT tool, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tfw * 2.2 / (1.2 + tfw)) AS score FROM wt JOIN df ON wt.term = df.term, n GROUP BY tool)
SELECT tl.tool, round(coalesce(score, 0.0), 9) AS score FROM tl LEFT JOIN sc ON tl.tool = sc.tool"""

ORACLES = {
    "token_estimate": f"SELECT doc_id, {_EST} AS tokens FROM documents",
    "segment_roles": f"SELECT role, count(*) AS segments, CAST(sum({_EST}) AS BIGINT) AS tokens FROM conversations GROUP BY role",
    "dedup_exact": f"WITH {_lines_of('documents', 'doc_id')}, {_DEDUP.replace('K', 'doc_id')} SELECT d.doc_id, CASE WHEN most > 1 THEN folded ELSE text END AS text FROM documents d LEFT JOIN fo ON d.doc_id = fo.doc_id",
    "dedup_adjacent": f"""WITH {_lines_of('documents', 'doc_id')},
nw AS (SELECT *, CASE WHEN trim(line) = '' OR line IS DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM ln),
il AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM nw),
rn AS (SELECT doc_id, island, min(pos) AS pos, min(line) AS line, count(*) AS n FROM il GROUP BY doc_id, island)
SELECT doc_id, string_agg(CASE WHEN n > 1 THEN line || ' [×' || n || ']' ELSE line END, chr(10) ORDER BY pos) AS text FROM rn GROUP BY doc_id""",
    "compress_report": f"""WITH {_SEGS}, s2 AS (SELECT * FROM sg WHERE NOT instruction),
s3 AS (SELECT request_id * 1000 + seg_ix AS id, request_id, text FROM s2), {_lines_of('s3', 'id')}, {_DEDUP.replace('K', 'id')},
nw AS (SELECT request_id, s3.text AS old, CASE WHEN most > 1 THEN folded ELSE s3.text END AS new FROM s3 LEFT JOIN fo ON s3.id = fo.id),
tk AS (SELECT request_id, count(*) AS segments, CAST(sum({_EST.replace('text', 'old')}) AS BIGINT) AS b, CAST(sum({_EST.replace('text', 'new')}) AS BIGINT) AS a FROM nw GROUP BY request_id)
SELECT request_id, segments, b AS tokens_before, least(a, b) AS tokens_after, a < b AS applied FROM tk""",
    "output_kind": _LOG + f""", g AS (SELECT seg, count(*) AS n, count(*) FILTER (WHERE regexp_matches(line, {_LEVEL})) AS lv, count(*) FILTER (WHERE regexp_matches(line, {_STRONG})) AS st,
  count(*) FILTER (WHERE regexp_matches(line, {_sq(X.GREP_LINE)})) AS gr FROM log_lines GROUP BY seg)
SELECT seg, CASE WHEN n >= 3 AND gr >= 3 AND gr * 4 >= n * 3 THEN 'grep' WHEN n >= 8 AND (lv * 100 >= n * 30 OR (st >= 2 AND st * 10 >= n)) THEN 'log' END AS kind FROM g""",
    "line_priority": _LOG + f"SELECT seg, pos, {_PRI} AS priority, CASE WHEN line LIKE '%purchase%' OR line LIKE '% click %' THEN 0.4 ELSE 0.2 END AS bonus FROM log_lines",
    "level_census": _LOG + f", p AS (SELECT seg, {_PRI} AS p FROM log_lines) SELECT seg, count(*) AS lines, count(*) FILTER (WHERE p >= 1.0) AS errors, count(*) FILTER (WHERE p >= 0.6 AND p < 1.0) AS warnings FROM p GROUP BY seg",
    "errors_only": _KEEP + "SELECT seg, pos, keep FROM k",
    "elide_runs": _KEEP + """, w AS (SELECT *, CASE WHEN keep IS DISTINCT FROM lag(keep) OVER (PARTITION BY seg ORDER BY pos) THEN 1 ELSE 0 END AS new FROM k),
i AS (SELECT *, sum(new) OVER (PARTITION BY seg ORDER BY pos) AS island FROM w),
g AS (SELECT seg, min(pos) AS pos, bool_and(keep) AS keep, count(*) AS n, sum(strlen(line) + 1) AS size, string_agg(line, chr(10) ORDER BY pos) AS raw FROM i GROUP BY seg, island),
m AS (SELECT *, CASE WHEN n = 1 THEN '[… 1 line omitted …]' ELSE '[… ' || n || ' lines omitted …]' END AS mark FROM g)
SELECT seg, pos, n, NOT keep AND strlen(mark) + 1 < size AS hidden, CASE WHEN NOT keep AND strlen(mark) + 1 < size THEN mark ELSE raw END AS text FROM m""",
    "template_mask": _LOG + f"SELECT {_TPL} AS template, count(*) AS n FROM log_lines GROUP BY 1",
    "template_fold": _LOG + f""", t AS (SELECT *, {_TPL} AS tpl, regexp_extract_all(line, {_VAR}) AS vars FROM log_lines),
w AS (SELECT *, CASE WHEN tpl IS DISTINCT FROM lag(tpl) OVER (PARTITION BY seg ORDER BY pos) THEN 1 ELSE 0 END AS new FROM t),
i AS (SELECT *, sum(new) OVER (PARTITION BY seg ORDER BY pos) AS island FROM w),
g AS (SELECT seg, min(pos) AS pos, count(*) AS n, min(tpl) AS tpl, string_agg('(' || array_to_string(vars, ',') || ')', ' ' ORDER BY pos) AS rws, string_agg(line, chr(10) ORDER BY pos) AS raw FROM i GROUP BY seg, island),
s AS (SELECT *, tpl || ' [×' || n || ': ' || rws || ']' AS short FROM g),
f AS (SELECT *, n >= 3 AND tpl LIKE '%{{}}%' AND strlen(short) < strlen(raw) + 1 AS folded FROM s)
SELECT seg, pos, n AS run, folded, CASE WHEN folded THEN short ELSE raw END AS text FROM f""".replace("{{}}", "{}"),
    "grep_first_per_file": cte("grep_lines") + r""", f AS (SELECT *, nullif(regexp_extract(line, '^((?:[A-Za-z]:)?[^:\n]*):\d+:', 1), '') AS file FROM grep_lines)
SELECT seg, pos, line, file, file IS NOT NULL AND row_number() OVER (PARTITION BY seg, file ORDER BY pos) = 1 AS first FROM f""",
    "top_lines": _LOG + f""", p AS (SELECT *, {_PRI} AS score, row_number() OVER (PARTITION BY seg ORDER BY pos) AS rn, count(*) OVER (PARTITION BY seg) AS n FROM log_lines),
q AS (SELECT seg, pos, line, score, rn <= 3 OR rn > n - 3 OR score >= 1.0 AS forced FROM p)
SELECT *, forced OR row_number() OVER (PARTITION BY seg ORDER BY forced DESC, score DESC, pos) <= 8 AS keep FROM q""",
    "route_preset": f"""WITH {_SEGS}, g AS (SELECT request_id, bool_or(text LIKE '%```%') AS fence, count(*) FILTER (WHERE NOT instruction) AS turns, max(length(text)) AS longest FROM sg GROUP BY request_id)
SELECT request_id, turns, longest, CASE WHEN fence THEN 'code' WHEN turns >= 2 AND longest >= 1200 THEN 'rag' ELSE 'aggressive' END AS preset FROM g""",
    "frozen_prefix": f"WITH {_SEGS} SELECT request_id, seg_ix, coalesce(seg_ix <= max(CASE WHEN length(text) > 300 THEN seg_ix END) OVER (PARTITION BY request_id), FALSE) AS frozen FROM sg",
    "question_terms": f"""WITH {_SEGS}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seg_ix DESC) AS nr FROM sg WHERE role = 'user')
SELECT request_id, seg_ix AS q_ix, CASE WHEN length(text) < 600 THEN coalesce(array_to_string(list_sort(list_distinct({_words('text')})), ' '), '') ELSE '' END AS query FROM r WHERE nr = 1""",
    "terminal_normal": _LOG + "SELECT seg, pos, line || chr(10) || 'end' AS text FROM log_lines",
    "answer_normal": r"""SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'), ' '),
  lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM documents""",
    "significant": """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice = 0 OR l_extendedprice = floor(l_extendedprice) THEN l_extendedprice
  ELSE round(l_extendedprice * pow(10.0, 3 - floor(log10(abs(l_extendedprice))))) / pow(10.0, 3 - floor(log10(abs(l_extendedprice)))) END, 6) AS v FROM lineitem""",
    "bm25_rank": _CHUNKS + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM bm) SELECT doc_id, pos, score, rank FROM r WHERE rank <= 5",
    "bm25_chunks": _CHUNKS + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM bm) SELECT doc_id, pos, score, rank FROM r WHERE rank <= 5",
    "feedback_terms": _CHUNKS + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM bm WHERE score > 0),
b AS (SELECT doc_id, pos, score / sum(score) OVER (PARTITION BY doc_id) AS share FROM r WHERE rank <= 4),
w AS (SELECT tf.doc_id, tf.term, round(sum(share * tf / dl), 12) AS weight FROM tf JOIN b ON tf.doc_id = b.doc_id AND tf.pos = b.pos GROUP BY tf.doc_id, tf.term),
k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM w) SELECT * FROM k WHERE rank <= 10""",
    "bm25f_tools": _TOOLF,
    "coverage": f"""WITH {_SEGS}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seg_ix DESC) AS nr FROM sg WHERE role = 'user'),
q AS (SELECT request_id, seg_ix AS q_ix, CASE WHEN length(text) < 600 THEN list_distinct({_words('text')}) ELSE [] END AS q FROM r WHERE nr = 1),
w AS (SELECT sg.request_id, seg_ix, q, {_words('text')} AS s, {_words("string_split(text, chr(10))[1]")} AS k FROM sg JOIN q ON q.request_id = sg.request_id WHERE seg_ix <> q_ix AND role = 'assistant'),
b AS (SELECT *, list_intersect(list_distinct(s), q) AS uni,
  list_distinct(list_filter(list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]), lambda x: list_contains(q, split_part(x, ' ', 1)) OR list_contains(q, split_part(x, ' ', 2)))) AS bi,
  list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]) AS kb FROM w)
SELECT request_id, seg_ix, round(CASE WHEN len(uni) + len(bi) > 0 THEN (len(list_intersect(uni, k)) + len(list_intersect(bi, kb))) * 1.0 / (len(uni) + len(bi)) ELSE 1.0 END, 9) AS coverage FROM b""",
    "structured_segment": f"""WITH i AS (SELECT doc_id, {_SHAPES} AS text FROM documents), l AS (SELECT *, trim(text, ' ') AS t, {_SOLID} AS ls FROM i),
c AS (SELECT *, len(ls) AS n, {', '.join(f"list_transform(ls, lambda x: length(x) - length(replace(x, {d}, ''))) AS c{k}" for k, d in enumerate(("','", "chr(9)", "'|'", "';'")))},
  len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[\\w.\\-]+\\s*[:=]\\s*\\S'))) AS kv, length(regexp_replace(t, '\\s', '', 'g')) AS solid, len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}\\s]')) AS signs FROM l)
SELECT doc_id, coalesce((regexp_matches(t, '^[\\[{{]') AND json_valid(t)) OR contains(t, '}},{{'), FALSE)
  OR (n >= 3 AND (kv * 4 >= n * 3 OR {' OR '.join(f"(list_max(c{k}) > 0 AND len(list_filter(c{k}, lambda x: x = list_max(c{k}))) * 4 >= n * 3)" for k in range(4))}))
  OR (solid >= 40 AND signs * 100 >= solid * 22) AS structured FROM c""",
    "generated_kind": f"""WITH i AS (SELECT doc_id, {_FILES} AS text FROM documents), l AS (SELECT *, {_SOLID} AS ls FROM i),
c AS (SELECT doc_id, text, len(ls) AS n, len(list_filter(ls, lambda x: regexp_matches(x, {_sq(X.LOCK_RECORD)}))) AS records, regexp_matches(text, {_sq(X.LOCK_HEADER)}) AS header,
  len(list_filter(ls, lambda x: length(x) >= 2000 AND len(regexp_extract_all(x, '\\s')) * 100 < length(x) * 8 AND len(regexp_extract_all(x, '[{{}}();,=]')) * 100 >= length(x) * 4)) > 0 AS packed,
  regexp_matches(text, '[A-Za-z0-9+/=]{{1000}}[A-Za-z0-9+/=]{{500}}') AS blob FROM l)
SELECT doc_id, CASE WHEN length(text) < 800 THEN NULL WHEN header OR (n >= 12 AND records * 100 >= n * 15) THEN 'lockfile' WHEN packed THEN 'minified' WHEN blob THEN 'base64' END AS kind FROM c""",
    "bigram_curve": _CURVE + "SELECT * FROM cu",
    "knee": _CURVE + """, i AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY seg) AS n, max(seen) OVER (PARTITION BY seg) AS total FROM cu),
b AS (SELECT seg, i, round(seen * 1.0 / total - i * 1.0 / (n - 1), 12) AS bow FROM i WHERE n >= 3 AND total > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY bow DESC, i) AS nr FROM b) SELECT seg, CASE WHEN bow > 0.05 THEN i END AS knee FROM r WHERE nr = 1""",
    "prefix_hash": _CHAIN + "SELECT * FROM ch",
    "known_prefix": _CHAIN + """, st AS (SELECT DISTINCT prefix FROM ch WHERE seg_ix <= 2),
h AS (SELECT request_id, seg_ix, ch.prefix IN (SELECT prefix FROM st) AS hit FROM ch)
SELECT request_id, CAST(coalesce(min(seg_ix) FILTER (WHERE NOT hit), max(seg_ix) + 1) - min(seg_ix) AS BIGINT) AS reused FROM h GROUP BY request_id""",
    "rare_rows": """WITH o AS (SELECT CAST(o_custkey % 50 AS BIGINT) AS g, o_orderkey AS pos, o_orderpriority || '/' || o_orderstatus AS v FROM orders),
c AS (SELECT g, v, count(*) AS c FROM o GROUP BY g, v), s AS (SELECT g, count(*) AS vals, sum(c) AS n FROM c GROUP BY g),
r AS (SELECT c.g, c.v FROM c JOIN s ON c.g = s.g WHERE c * 20 <= n AND vals >= 2 AND vals <= least(greatest(n / 10, 2), 24)) SELECT o.g, o.pos, o.v FROM o JOIN r ON o.g = r.g AND o.v = r.v""",
}

"""Ledger queries of the catalog with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenweir.operators import ledger as L
from tokenweir.sources.derived import cte, frame

_SAVED = """CASE WHEN input_before > 0 AND input_after IS NOT NULL THEN
  CAST(floor(greatest(CAST(floor(fresh_input * input_rate + cache_read * cache_read_rate + cache_write * cache_write_rate + 0.5) AS BIGINT), 0) * p / (1 - p) + 0.5) AS BIGINT) ELSE 0 END"""
_TURNS = cte("turns")
_SV = _TURNS + f""", sp AS (SELECT *, least(greatest(CAST(input_before - input_after AS DOUBLE) / input_before, 0.0), 0.95) AS p FROM turns),
sv AS (SELECT *, CAST({_SAVED} AS BIGINT) AS saved_micros FROM sp)
"""
_COMP = cte("compressions")
_UNPRICED = "input_rate = 0 AND output_rate = 0 AND cache_read_rate = 0 AND cache_write_rate = 0 AND bill_micros = 0 AND model IS NOT NULL"
_SUMS = """count(*) AS turns, CAST(coalesce(sum(input_before), 0) AS BIGINT) AS input_before,
  CAST(coalesce(sum(input_after) FILTER (WHERE input_before IS NOT NULL), 0) AS BIGINT) AS input_after,
  CAST(sum(bill_micros) AS BIGINT) AS bill_micros, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  count(input_before) > 0 AS has_savings_data, max(ts) AS last_ts"""
_CAT = cte("turns", "blocks") + """, sb AS (SELECT *, CASE WHEN tool_name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN nullif(string_split(substr(tool_name, 6), '__')[1], '') END AS mcp_server FROM blocks),
tape AS (SELECT sb.*, CASE WHEN zone = 'output' THEN 'Output' WHEN section = 'static' THEN 'Static' ELSE 'Messages' END AS group_label,
  CASE WHEN zone = 'output' THEN bucket WHEN bucket = 'system' THEN 'System prompt'
    WHEN bucket = 'schema' THEN CASE WHEN mcp_server IS NOT NULL THEN 'MCP tools' ELSE 'System tools' END
    WHEN bucket = 'text' THEN CASE WHEN role = 'user' THEN 'user text' ELSE 'assistant text' END
    WHEN bucket = 'tool_result' THEN 'system tool use+output' ELSE bucket END AS label,
  CAST(cache_read AS DOUBLE) AS r, CAST(cache_read + cache_write AS DOUBLE) AS rw,
  sum(raw_tokens) OVER (PARTITION BY turn_id, zone ORDER BY sb.id) AS hi0, raw_tokens AS raw0,
  CASE WHEN zone = 'input' THEN fresh_input + cache_read + cache_write ELSE output_tok END AS paid,
  sum(raw_tokens) OVER (PARTITION BY turn_id, zone) AS total, input_rate, output_rate, cache_read_rate, cache_write_rate, session_id
  FROM sb JOIN turns t ON sb.turn_id = t.id),
sc AS (SELECT *, CASE WHEN paid > 0 THEN CAST(paid AS DOUBLE) / CAST(total AS DOUBLE) ELSE 1.0 END AS scale FROM tape),
al AS (SELECT *, CAST(hi0 AS DOUBLE) * scale AS hi, CAST(hi0 - raw0 AS DOUBLE) * scale AS lo FROM sc),
sh AS (SELECT *, CASE WHEN zone = 'input' THEN greatest(hi - greatest(lo, rw), 0.0) ELSE 0.0 END AS fresh_tok,
  CASE WHEN zone = 'input' THEN greatest(least(hi, r) - lo, 0.0) ELSE 0.0 END AS cache_read_tok,
  CASE WHEN zone = 'input' THEN greatest(least(hi, rw) - greatest(lo, r), 0.0) ELSE 0.0 END AS cache_write_tok,
  CASE WHEN zone = 'input' THEN 0.0 ELSE hi - lo END AS output_tok_share FROM al)
"""


def _t(f, *names):
    """A query from derived frames."""
    return lambda spark, d: f(*[frame(spark, d, n) for n in names or ("turns",)])


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _prices(spark):
    rows = [("m0", 3.0), ("acme/m1", 1.0), ("m2", 0.5), ("a/m3", 2.0), ("b/m3", 4.0)]
    return spark.createDataFrame(rows, "id string, input_rate double")


def _rates(spark):
    return spark.createDataFrame([("free", 0.5, 2.0, 0.1, 1.25)], "model string, in_rate double, out_rate double, read_share double, write_share double")


QUERIES = {
    "ledger_summary": _t(lambda c: _rounded(L.summary(c), "avg_micros"), "compressions"),
    "ledger_by_model": _t(L.by_model, "compressions"),
    "ledger_by_model_since": _t(lambda c: L.by_model(c, "2024-01-20"), "compressions"),
    "ledger_by_day": _t(lambda c: _rounded(L.by_period(c, "day"), "saved_pct"), "compressions"),
    "ledger_by_week": _t(lambda c: _rounded(L.by_period(c, "week"), "saved_pct"), "compressions"),
    "ledger_by_month": _t(lambda c: _rounded(L.by_period(c, "month"), "saved_pct"), "compressions"),
    "agent_aggregates": _t(L.agent_aggregates),
    "project_aggregates": _t(lambda t: L.project_aggregates(t, "codex")),
    "session_aggregates": _t(lambda t: L.session_aggregates(t, "codex", None)),
    "agent_trend": _t(lambda t: L.agent_trend(t, "codex", "day", 10)),
    "ledger_sessions": _t(L.sessions),
    "occupancy": _t(lambda b: L.occupancy(b), "blocks"),
    "prefix_tape": _t(lambda b, t: _rounded(L.prefix_tape(b, t), "fresh_tok", "cache_read_tok", "cache_write_tok", "output_tok_share"), "blocks", "turns"),
    "cost_by_source": _t(lambda b, t: _rounded(L.cost_by_source(b, t), "fresh_usd", "cache_usd", "output_usd", "total_usd"), "blocks", "turns"),
    "saved_micros": _t(lambda t: L.with_saved(t).select("id", "saved_micros")),
    "money_totals": _t(L.money_totals),
    "money_totals_since": _t(lambda t: L.money_totals(t, "2024-01-15")),
    "money_by_day": _t(lambda t: L.money_by_day(t, 14)),
    "money_by_model": _t(lambda t: L.money_by_model(t, 3)),
    "padded_daily_saved": _t(lambda t: _rounded(L.padded_daily_saved(t, 45), "saved_usd")),
    "money_coverage": _t(lambda t, c: _rounded(L.money_coverage(t, c), "coverage"), "turns", "compressions"),
    "session_bill": _t(L.session_bill),
    "unpriced_models": _t(L.unpriced_models),
    "dashboard": _t(lambda t: _rounded(L.dashboard(t), "saved_pct")),
    "reprice": lambda spark, d: L.reprice(frame(spark, d, "turns"), _rates(spark)),
    "prune": _t(lambda t: L.prune(t, "2024-01-10", 5000).select("id", "ts", "session_id")),
    "prune_blocks": _t(lambda b, t: L.prune_blocks(b, L.prune(t, "2024-01-10", 5000)).select("id", "turn_id", "raw_tokens"), "blocks", "turns"),
    "model_views": _t(lambda c: _rounded(L.model_views(c), "new_content_pct"), "compressions"),
    "cost_estimate": lambda spark, d: _rounded(
        L.cost_estimate(L.by_model(frame(spark, d, "compressions")), _prices(spark)), "saved_usd", "spend_usd", "net_spend_usd", "net_saved_usd"
    ),
    "resolve_prices": lambda spark, d: L.resolve_prices(frame(spark, d, "compressions").select("id", "model"), _prices(spark)),
}

_BM = """SELECT provider, model, count(*) AS events, CAST(sum(input_before) AS BIGINT) AS input_before, CAST(sum(input_after) AS BIGINT) AS input_after,
  CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read,
  CAST(sum(coalesce(fresh_input_tokens, greatest(input_after - coalesce(cache_read_tokens, 0), 0))) AS BIGINT) AS fresh,
  CAST(coalesce(sum(output_after) FILTER (WHERE output_shaped), 0) AS BIGINT) AS shaped_output FROM compressions"""


def _period(expr: str) -> str:
    return _COMP + f"""SELECT {expr} AS period, count(*) AS events, CAST(sum(input_before) AS BIGINT) AS input_before, CAST(sum(input_after) AS BIGINT) AS input_after,
  CAST(sum(input_before) - sum(input_after) AS BIGINT) AS saved,
  round(CASE WHEN sum(input_before) > 0 THEN CAST(sum(input_before) - sum(input_after) AS DOUBLE) / sum(input_before) * 100.0 ELSE 0.0 END, 6) AS saved_pct
  FROM compressions GROUP BY 1"""


_MONEY = f"""SELECT count(*) AS turns, CAST(coalesce(sum(saved_micros), 0) AS BIGINT) AS saved_micros, CAST(coalesce(sum(bill_micros), 0) AS BIGINT) AS paid_micros,
  count(*) FILTER (WHERE {_UNPRICED}) AS unpriced_turns, count(DISTINCT CASE WHEN {_UNPRICED} THEN model END) AS unpriced_models FROM sv"""
_PRICE = """, pr(id, input_rate) AS (VALUES ('m0', 3.0), ('acme/m1', 1.0), ('m2', 0.5), ('a/m3', 2.0), ('b/m3', 4.0)),
al AS (SELECT substr(id, instr(id, '/') + 1) AS a, max(input_rate) AS r FROM pr WHERE instr(id, '/') > 0 GROUP BY 1 HAVING count(*) = 1)
"""

ORACLES = {
    "ledger_summary": _COMP + """SELECT provider, count(*) AS events, CAST(sum(input_before) AS BIGINT) AS input_before, CAST(sum(input_after) AS BIGINT) AS input_after,
  count(*) FILTER (WHERE NOT exact) AS inexact, count(output_after) AS with_output, round(avg(compress_micros), 6) AS avg_micros, max(ts) AS last_ts,
  CAST(sum(input_before) FILTER (WHERE frozen_input_tokens IS NOT NULL) AS BIGINT) AS metered_before,
  CAST(sum(input_after) FILTER (WHERE frozen_input_tokens IS NOT NULL) AS BIGINT) AS metered_after,
  CAST(sum(frozen_input_tokens) AS BIGINT) AS frozen FROM compressions GROUP BY provider""",
    "ledger_by_model": _COMP + _BM + " GROUP BY provider, model",
    "ledger_by_model_since": _COMP + _BM + " WHERE ts >= '2024-01-20' GROUP BY provider, model",
    "ledger_by_day": _period("substr(ts, 1, 10)"),
    "ledger_by_month": _period("substr(ts, 1, 7)"),
    "ledger_by_week": _period("strftime(CAST(ts AS TIMESTAMP), '%Y-W%W')"),
    "agent_aggregates": _TURNS + f"SELECT agent, {_SUMS} FROM turns GROUP BY agent",
    "project_aggregates": _TURNS + f"SELECT project, {_SUMS} FROM turns WHERE agent = 'codex' GROUP BY project",
    "session_aggregates": _TURNS + f"SELECT session_id, {_SUMS}, arg_max(coalesce(session_name, '~'), ts || lpad(CAST(id AS VARCHAR), 12, '0')) AS session_name FROM turns WHERE agent = 'codex' AND project IS NULL GROUP BY session_id",
    "agent_trend": _TURNS + """SELECT substr(ts, 1, 10) AS period, CAST(coalesce(sum(input_before), 0) AS BIGINT) AS input_before,
  CAST(coalesce(sum(input_after) FILTER (WHERE input_before IS NOT NULL), 0) AS BIGINT) AS input_after FROM turns WHERE agent = 'codex' GROUP BY 1 ORDER BY 1 DESC LIMIT 10""",
    "ledger_sessions": _TURNS + """, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, cc_session_id, agent, project ORDER BY (session_name IS NULL), id DESC) AS named,
  row_number() OVER (PARTITION BY session_id, cc_session_id, agent, project ORDER BY id DESC) AS newest FROM turns)
SELECT session_id, cc_session_id, agent, project, count(*) AS turns, min(ts) AS first_ts, max(ts) AS last_ts, max(CASE WHEN named = 1 THEN session_name END) AS session_name,
  max(CASE WHEN newest = 1 THEN model END) AS model, max(CASE WHEN newest = 1 THEN win END) AS win, CAST(sum(fresh_input) AS BIGINT) AS fresh_input,
  CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output_tok) AS BIGINT) AS output_tok,
  CAST(sum(bill_micros) AS BIGINT) AS bill_micros, max(id) AS last_id, max(CASE WHEN newest = 1 THEN fresh_input + cache_read + cache_write END) AS last_input
FROM r GROUP BY session_id, cc_session_id, agent, project""",
    "occupancy": _CAT + "SELECT turn_id, section, bucket, group_label, label, CAST(sum(raw_tokens) AS BIGINT) AS raw_tokens FROM sh WHERE zone = 'input' GROUP BY ALL",
    "prefix_tape": _CAT + """SELECT id, turn_id, zone, section, bucket, group_label, label, mcp_server, tool_name, raw_tokens, round(fresh_tok, 6) AS fresh_tok,
  round(cache_read_tok, 6) AS cache_read_tok, round(cache_write_tok, 6) AS cache_write_tok, round(output_tok_share, 6) AS output_tok_share FROM sh""",
    "cost_by_source": _CAT + """, c AS (SELECT group_label, label, sum(fresh_tok * input_rate / 1e6) AS f,
  sum((cache_read_tok * cache_read_rate + cache_write_tok * cache_write_rate) / 1e6) AS c, sum(output_tok_share * output_rate / 1e6) AS o FROM sh GROUP BY group_label, label)
SELECT group_label, label, round(f, 6) AS fresh_usd, round(c, 6) AS cache_usd, round(o, 6) AS output_usd, round(f + c + o, 6) AS total_usd FROM c""",
    "saved_micros": _SV + "SELECT id, saved_micros FROM sv",
    "money_totals": _SV + _MONEY,
    "money_totals_since": _SV + _MONEY + " WHERE ts >= '2024-01-15'",
    "money_by_day": _SV + "SELECT substr(ts, 1, 10) AS day, CAST(sum(saved_micros) AS BIGINT) AS saved_micros, CAST(sum(bill_micros) AS BIGINT) AS paid_micros FROM sv GROUP BY 1 ORDER BY 1 DESC LIMIT 14",
    "money_by_model": _SV + "SELECT coalesce(model, '(unknown)') AS model, count(*) AS turns, CAST(sum(saved_micros) AS BIGINT) AS saved_micros, CAST(sum(bill_micros) AS BIGINT) AS paid_micros FROM sv GROUP BY 1 ORDER BY 3 DESC, 4 DESC, 1 LIMIT 3",
    "padded_daily_saved": _SV + """, b AS (SELECT max(CAST(substr(ts, 1, 10) AS DATE)) AS last FROM sv),
g AS (SELECT CAST(last - CAST(i AS INTEGER) AS DATE) AS d FROM b, range(0, 45) r(i)),
s AS (SELECT CAST(substr(ts, 1, 10) AS DATE) AS d, sum(saved_micros) / 1e6 AS u FROM sv GROUP BY 1)
SELECT strftime(g.d, '%Y-%m-%d') AS day, round(coalesce(u, 0.0), 6) AS saved_usd FROM g LEFT JOIN s ON g.d = s.d""",
    "money_coverage": cte("turns", "compressions") + """, t AS (SELECT count(*) AS turns FROM turns), c AS (SELECT count(*) AS events FROM compressions)
SELECT turns, events, round(least(turns * 1.0 / events, 1.0), 6) AS coverage, events > 0 AND turns = 0 AS traffic_without_money, turns > 0 AND turns < events AS partial FROM t, c""",
    "session_bill": _TURNS + "SELECT session_id, CAST(sum(bill_micros) AS BIGINT) AS bill_micros FROM turns GROUP BY session_id",
    "unpriced_models": _TURNS + f"SELECT DISTINCT model FROM turns WHERE {_UNPRICED}",
    "dashboard": _TURNS + f""", a AS (SELECT agent, {_SUMS} FROM turns GROUP BY agent),
c AS (SELECT CASE agent WHEN 'desk-agent' THEN 'Desk Agent' WHEN 'codex' THEN 'Codex' WHEN 'my_agent-one' THEN 'My Agent One' ELSE 'Unknown' END AS card, turns, input_before, input_after, bill_micros FROM a
  UNION ALL SELECT 'total', CAST(sum(turns) AS BIGINT), CAST(sum(input_before) AS BIGINT), CAST(sum(input_after) AS BIGINT), CAST(sum(bill_micros) AS BIGINT) FROM a)
SELECT *, round(CASE WHEN input_before > 0 THEN CAST(greatest(input_before - input_after, 0) AS DOUBLE) / input_before * 100.0 ELSE 0.0 END, 6) AS saved_pct FROM c""",
    "reprice": _TURNS + f""", f AS (SELECT *, ({_UNPRICED}) AND coalesce(model = 'free', FALSE) AS fix FROM turns)
SELECT id, model, CASE WHEN fix THEN 0.5 ELSE input_rate END AS input_rate, CASE WHEN fix THEN 2.0 ELSE output_rate END AS output_rate,
  CASE WHEN fix THEN CAST(floor(fresh_input * 0.5 + cache_read * (0.5::DOUBLE * 0.1) + cache_write * (0.5::DOUBLE * 1.25) + output_tok * 2.0 + 0.5) AS BIGINT) ELSE bill_micros END AS bill_micros FROM f""",
    "prune": _TURNS + "SELECT id, ts, session_id FROM turns WHERE ts >= '2024-01-10' AND id > (SELECT max(id) FROM turns) - 5000",
    "prune_blocks": cte("turns", "blocks") + "SELECT id, turn_id, raw_tokens FROM blocks WHERE turn_id IN (SELECT id FROM turns WHERE ts >= '2024-01-10' AND id > (SELECT max(id) FROM turns) - 5000)",
    "model_views": _COMP + """, g AS (SELECT provider, model, count(*) AS events, coalesce(sum(cache_read_tokens), 0) AS cr,
  sum(input_before) FILTER (WHERE frozen_input_tokens IS NOT NULL) AS mb, sum(input_after) FILTER (WHERE frozen_input_tokens IS NOT NULL) AS ma, coalesce(sum(frozen_input_tokens), 0) AS fr
  FROM compressions GROUP BY provider, model)
SELECT provider, model, events, cr > 0 AS cached, round(CASE WHEN fr > 0 THEN CASE WHEN mb - fr > 0 THEN CAST(mb - ma AS DOUBLE) / (mb - fr) * 100.0 ELSE 0.0 END END, 6) AS new_content_pct
FROM g ORDER BY events DESC, provider, model NULLS FIRST LIMIT 8""",
    "cost_estimate": _COMP + _PRICE + f""", m AS ({_BM} GROUP BY provider, model),
j AS (SELECT m.*, coalesce(pr.input_rate, al.r) AS rate, CASE provider WHEN 'anthropic' THEN 0.1 WHEN 'openai' THEN 0.5 ELSE 0.25 END AS rd,
  least(greatest(CAST(input_before - input_after AS DOUBLE) / input_before, 0.0), 0.95) AS p FROM m LEFT JOIN pr ON m.model = pr.id LEFT JOIN al ON m.model = al.a)
SELECT round(CAST(sum(CAST((input_before - input_after) * rate / 1e6 AS DECIMAL(30,12))) AS DOUBLE), 6) AS saved_usd, round(CAST(sum(CAST(input_after * rate / 1e6 AS DECIMAL(30,12))) AS DOUBLE), 6) AS spend_usd,
  round(CAST(sum(CAST((fresh + cache_read * rd) * rate / 1e6 AS DECIMAL(30,12))) AS DOUBLE), 6) AS net_spend_usd, round(CAST(sum(CAST((fresh + cache_read * rd) * rate / 1e6 * p / (1 - p) AS DECIMAL(30,12))) AS DOUBLE), 6) AS net_saved_usd FROM j WHERE rate IS NOT NULL""",
    "resolve_prices": _COMP + _PRICE + "SELECT c.id, c.model, CAST(coalesce(pr.input_rate, al.r) AS DOUBLE) AS input_rate FROM compressions c LEFT JOIN pr ON c.model = pr.id LEFT JOIN al ON c.model = al.a",
}
ORACLES["session_aggregates"] = _TURNS + f""", r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS nr FROM turns WHERE agent = 'codex' AND project IS NULL)
SELECT session_id, {_SUMS}, max(CASE WHEN nr = 1 THEN session_name END) AS session_name FROM r GROUP BY session_id"""

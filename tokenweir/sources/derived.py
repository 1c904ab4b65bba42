"""Inputs derived from the star-schema tables, by SQL text that Spark and DuckDB both run.

The driver's tables hold no ledger, logs, requests or record arrays; these views build
them row by row (no shuffle), so every query over them scans whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A ledger turn per event. Rates are USD per million tokens; the third model is unpriced.
TURNS = """
SELECT id, ts, session_id, CAST(NULL AS STRING) AS cc_session_id, agent, project, session_name, provider, model,
  CAST(NULL AS STRING) AS sub_provider, CAST(200000 AS BIGINT) AS win, fresh_input, cache_read, cache_write, output_tok,
  input_rate, output_rate, input_rate * 0.1 AS cache_read_rate, input_rate * 1.25 AS cache_write_rate,
  CAST(floor(fresh_input * input_rate + cache_read * (input_rate * 0.1) + cache_write * (input_rate * 1.25) + output_tok * output_rate + 0.5) AS BIGINT) AS bill_micros,
  input_before, CASE WHEN input_before IS NOT NULL THEN fresh_input + cache_read + cache_write END AS input_after
FROM (
  SELECT event_id AS id, substr(CAST(ts AS STRING), 1, 19) AS ts,
    concat('s', CAST(user_id AS STRING), '-', substr(CAST(ts AS STRING), 1, 10)) AS session_id,
    CASE user_id % 4 WHEN 0 THEN 'desk-agent' WHEN 1 THEN 'codex' WHEN 2 THEN 'my_agent-one' ELSE 'unknown' END AS agent,
    CASE WHEN user_id % 5 <> 0 THEN concat('/work/p', CAST(user_id % 7 AS STRING)) END AS project,
    CASE WHEN event_type = 'signup' THEN concat('name ', CAST(event_id % 9 AS STRING)) END AS session_name,
    CASE WHEN event_id % 3 = 1 THEN 'openai' ELSE 'anthropic' END AS provider,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'big' WHEN event_id % 3 = 1 THEN 'small' ELSE 'free' END AS model,
    CAST(floor(value * 10) AS BIGINT) AS fresh_input, event_id % 500 AS cache_read, event_id % 90 AS cache_write, event_id % 70 AS output_tok,
    CASE WHEN event_id % 11 = 0 OR event_id % 3 = 2 THEN CAST(0 AS DOUBLE) WHEN event_id % 3 = 0 THEN CAST(3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS input_rate,
    CASE WHEN event_id % 11 = 0 OR event_id % 3 = 2 THEN CAST(0 AS DOUBLE) WHEN event_id % 3 = 0 THEN CAST(15 AS DOUBLE) ELSE CAST(4 AS DOUBLE) END AS output_rate,
    CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 10) AS BIGINT) + event_id % 500 + event_id % 90 + event_id % 37 * 10 END AS input_before
  FROM {events}
) e
"""

#: A request per event, as the compression ledger keeps it.
COMPRESSIONS = """
SELECT event_id AS id, substr(CAST(ts AS STRING), 1, 19) AS ts,
  CASE event_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'google' END AS provider,
  CASE WHEN event_id % 11 <> 0 THEN concat('m', CAST(event_id % 4 AS STRING)) END AS model,
  event_id % 5 <> 0 AS exact, CAST(floor(value * 20) AS BIGINT) + 50 AS input_before,
  CAST(floor(value * 20) AS BIGINT) + 50 - event_id % 50 AS input_after,
  CASE WHEN event_id % 4 = 0 THEN event_id % 300 END AS output_before, CASE WHEN event_id % 2 = 0 THEN event_id % 200 END AS output_after,
  CASE WHEN event_id % 7 <> 0 THEN event_id % 9000 END AS compress_micros,
  CASE WHEN event_id % 6 <> 0 THEN event_id % 40 END AS cache_read_tokens,
  CASE WHEN event_id % 10 = 0 THEN event_id % 60 END AS fresh_input_tokens, event_id % 30 AS cache_write_tokens,
  CASE WHEN event_id % 9 <> 0 THEN event_id % 2 = 0 END AS output_shaped,
  CASE WHEN event_id % 8 = 0 THEN event_id % 45 END AS frozen_input_tokens
FROM {events}
"""

#: Four blocks per turn: system, schema, history, output.
BLOCKS = """
SELECT t.id * 4 + k.k AS id, t.id AS turn_id, CASE WHEN k.k = 3 THEN 'output' ELSE 'input' END AS zone,
  CASE k.k WHEN 0 THEN 'static' WHEN 1 THEN 'static' ELSE 'messages' END AS section,
  CASE k.k WHEN 0 THEN 'system' WHEN 1 THEN 'schema' WHEN 2 THEN CASE WHEN t.id % 2 = 0 THEN 'text' ELSE 'tool_result' END ELSE 'text' END AS bucket,
  CASE WHEN k.k = 1 AND t.id % 3 <> 0 THEN concat('mcp__srv', CAST(t.id % 3 AS STRING), '__t', CAST(t.id % 5 AS STRING)) WHEN k.k = 1 THEN 'bash' END AS tool_name,
  CASE k.k WHEN 2 THEN 'user' WHEN 3 THEN 'assistant' END AS role, CASE WHEN k.k >= 2 THEN k.k END AS msg_index,
  (t.id * 7 + k.k * 13) % 400 + 1 AS raw_tokens
FROM {turns} t CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k
"""

#: A log line per event; the segment is the user.
LOG_LINES = """
SELECT user_id AS seg, event_id AS pos, concat(substr(CAST(ts AS STRING), 1, 19),
  CASE event_type WHEN 'error' THEN ' ERROR' WHEN 'signup' THEN ' WARN' ELSE ' INFO' END,
  ' user ', CAST(user_id AS STRING), ' ', event_type, ' value ', CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS line
FROM {events}
"""

#: Search results per part: `dir/file.x:line: text`.
GREP_LINES = """
SELECT p_size AS seg, p_partkey AS pos, concat('src/', p_brand, '.rs:', CAST(p_partkey AS STRING), ': ', p_name, ' ', p_type) AS line FROM {part}
"""

#: Flat records per supplier nation, as compact JSON objects with ordered keys.
RECORDS = """
SELECT s_nationkey AS arr, s_suppkey AS pos, concat('{"id":', CAST(s_suppkey AS STRING), ',"name":"', s_name, '","nation":', CAST(s_nationkey AS STRING),
  CASE WHEN s_suppkey % 10 = 0 THEN ',"note":"late"' ELSE '' END, '}') AS record FROM {supplier}
"""

BASE = {"TURNS": ("events",), "COMPRESSIONS": ("events",), "LOG_LINES": ("events",), "GREP_LINES": ("part",), "RECORDS": ("supplier",)}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view `name` (lower case) over the tables of a folder."""
    if name == "blocks":
        return spark.sql(BLOCKS, turns=frame(spark, sf_dir, "turns"))
    key = name.upper()
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE[key]}
    text = globals()[key]
    if key == "RECORDS":
        text = text.replace('{"id"', '{{"id"').replace("'}'", "'}}'")
    return spark.sql(text, **tables)


def cte(*names: str) -> str:
    """`WITH ...` that defines the derived views by name for DuckDB."""
    parts = []
    for n in names:
        text = globals()[n.upper()]
        for t in ("events", "part", "supplier", "turns"):
            text = text.replace("{" + t + "}", t)
        parts.append(f"{n} AS ({text})")
    return "WITH " + ",\n".join(parts) + "\n"

"""Streaming operators: response streams to ledger rows, expiring stores, prefix memo, idle gaps.

State is keyed (stream, session or prefix), bounded by a time to live, and kept in Spark's
state store, so it survives lost executors with the query's checkpoint.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINAL = "stream_id string, provider string, fresh_input long, cache_read long, cache_write long, output long, outcome string"
_STATE = "buffer string, provider string, fresh long, read long, write long, output long, content boolean, done boolean"


def frames(buffer: str) -> tuple[list[dict], str]:
    """Whole `data:` frames of an event stream, and what is left of an unfinished line."""
    *whole, rest = buffer.split("\n")
    out = []
    for line in whole:
        line = line.strip("\r")
        if line.startswith("data:") and line[5:].strip() not in ("", "[DONE]"):
            try:
                v = json.loads(line[5:])
            except ValueError:
                continue
            if isinstance(v, dict):
                out.append(v)
    return out, rest


def usage(frame: dict) -> dict[str, int]:
    """fresh, read, write and output tokens that a response frame reports, by its shape."""
    u = frame.get("usage") or (frame.get("message") or {}).get("usage") or (frame.get("response") or {}).get("usage") or {}
    g = frame.get("usageMetadata") or {}
    if g:
        cached = g.get("cachedContentTokenCount") or 0
        return {"fresh": max(0, (g.get("promptTokenCount") or 0) - cached), "read": cached, "write": 0, "output": g.get("candidatesTokenCount") or 0}
    if "prompt_tokens" in u or "input_tokens_details" in u:
        cached = ((u.get("prompt_tokens_details") or u.get("input_tokens_details") or {}).get("cached_tokens")) or 0
        total = u.get("prompt_tokens") or u.get("input_tokens") or 0
        return {"fresh": max(0, total - cached), "read": cached, "write": 0, "output": u.get("completion_tokens") or u.get("output_tokens") or 0}
    return {
        "fresh": u.get("input_tokens") or 0, "read": u.get("cache_read_input_tokens") or 0,
        "write": u.get("cache_creation_input_tokens") or 0, "output": u.get("output_tokens") or 0,
    }


def has_content(frame: dict) -> bool:
    return bool(frame.get("choices") or frame.get("candidates") or frame.get("delta") or frame.get("content_block"))


def usage_columns(body: Column) -> dict[str, Column]:
    """The same from whole JSON response bodies, without Python."""
    g = lambda *ps: F.coalesce(*[F.get_json_object(body, p).cast("long") for p in ps], F.lit(0))
    cached = g("$.usage.prompt_tokens_details.cached_tokens", "$.usage.input_tokens_details.cached_tokens", "$.usageMetadata.cachedContentTokenCount", "$.usage.cache_read_input_tokens")
    total = F.coalesce(F.get_json_object(body, "$.usage.prompt_tokens").cast("long"), F.get_json_object(body, "$.usageMetadata.promptTokenCount").cast("long"))
    return {
        "fresh_input": F.when(total.isNotNull(), F.greatest(total - cached, F.lit(0))).otherwise(g("$.usage.input_tokens")),
        "cache_read": cached,
        "cache_write": g("$.usage.cache_creation_input_tokens"),
        "output": g("$.usage.completion_tokens", "$.usage.output_tokens", "$.usageMetadata.candidatesTokenCount"),
    }


def finalize(chunks: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """One ledger row per response stream (chunks: stream_id, provider, seq, data, last).

    Chunks may cut frames anywhere; the largest usage of a stream's frames counts. A stream
    without usage is incomplete if it had content, else empty. It ends with its last chunk
    or after `idle` without any.
    """
    timeout = pd.Timedelta(idle)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, provider, fresh, read, write, output, content, done = state.get if state.exists else ("", None, 0, 0, 0, 0, False, False)
        if not state.hasTimedOut:
            for pdf in batches:
                for row in pdf.sort_values("seq").itertuples():
                    provider = row.provider or provider
                    found, buffer = frames(buffer + (row.data or "") + ("\n" if row.last else ""))
                    for f in found:
                        u = usage(f)
                        fresh, read, write, output = (max(a, int(b)) for a, b in zip((fresh, read, write, output), (u["fresh"], u["read"], u["write"], u["output"])))
                        content |= has_content(f)
                    done |= bool(row.last)
        if done or state.hasTimedOut:
            outcome = "ok" if fresh + read + write + output > 0 else "incomplete_stream" if content else "empty_stream"
            state.remove()
            yield pd.DataFrame([(key[0], provider, fresh, read, write, output, outcome)], columns=[c.split(" ")[0] for c in FINAL.split(", ")])
        else:
            state.update((buffer, provider, fresh, read, write, output, content, done))
            state.setTimeoutDuration(int(timeout.total_seconds() * 1000))

    return chunks.groupBy("stream_id").applyInPandasWithState(step, FINAL, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


STORED = "session string, handle string, outcome string"


def recall_store(results: DataFrame, ttl: str = "1 hour", max_entries: int = 64, max_bytes: int = 1 << 20, secret: str = "") -> DataFrame:
    """Admits raw tool results per session (session, content): stored, seen or oversize.

    Entries are told apart by a digest over secret, session and content; the oldest leave
    until number and bytes are within their bounds; a session's store ends after `ttl`
    without results.
    """
    life = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entries: list = json.loads(state.get[0]) if state.exists else []
        rows = []
        for pdf in batches:
            for content in pdf["content"]:
                data = (content or "").encode()
                digest = hashlib.sha256(f"{secret}\0{key[0]}\0".encode() + data).hexdigest()
                known = next((e for e in entries if e[0] == digest), None)
                if len(data) > max_bytes:
                    rows.append((key[0], None, "oversize"))
                elif known:
                    rows.append((key[0], known[1], "seen"))
                else:
                    handle = "r_" + hashlib.sha256(("handle" + digest).encode()).hexdigest()[:43]
                    entries.append([digest, handle, len(data)])
                    while len(entries) > max_entries or sum(e[2] for e in entries) > max_bytes:
                        entries.pop(0)
                    rows.append((key[0], handle, "stored"))
        state.update((json.dumps(entries),))
        state.setTimeoutDuration(life)
        yield pd.DataFrame(rows, columns=["session", "handle", "outcome"])

    return results.groupBy("session").applyInPandasWithState(step, STORED, "entries string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def idle_gaps(turns: DataFrame, gap_seconds: int, min_tokens: int) -> DataFrame:
    """Turns that come after the cache's life with many tokens to read again (session, ts, tokens)."""
    from pyspark.sql import Window as W

    prev = F.lag("ts").over(W.partitionBy("session").orderBy("ts"))
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(prev.cast("timestamp"))
    return turns.withColumn("gap", gap).filter((F.col("gap") > gap_seconds) & (F.col("tokens") >= min_tokens))


def windowed_usage(turns: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: usage per event-time window and type under a watermark (ts, event_type, value); late rows are left out."""
    return (
        turns.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )

"""Streaming operators driven to the end over file sources."""

import json

import pytest

from tokenweir.streaming import responses

CHUNK = "stream_id string, provider string, seq long, data string, last boolean"


def run(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    return spark.table(name).collect()


def test_finalizer_joins_cut_frames(spark, tmp_path):
    frame = "data: " + json.dumps({"message": {"usage": {"input_tokens": 10, "cache_read_input_tokens": 4}}}) + "\n"
    last = "data: " + json.dumps({"usage": {"output_tokens": 7}}) + "\n\ndata: [DONE]\n"
    rows = [
        ("a", "anthropic", 0, frame[:20], False), ("a", "anthropic", 1, frame[20:] + last[:9], False), ("a", "anthropic", 2, last[9:], True),
        ("b", "openai", 0, 'data: {"choices":[{"delta":{}}]}\n', True), ("c", "openai", 0, ": ping\n", True),
        ("d", "openai", 0, 'data: {"usage":{"prompt_tokens":9,"completion_tokens":2,"prompt_tokens_details":{"cached_tokens":3}}}', True),
        ("e", "google", 0, 'data: {"usageMetadata":{"promptTokenCount":9,"cachedContentTokenCount":2,"candidatesTokenCount":5}}\n', False),
    ]
    spark.createDataFrame(rows, CHUNK).write.parquet(str(tmp_path / "in"))
    out = run(spark, responses.finalize(spark.readStream.schema(CHUNK).parquet(str(tmp_path / "in"))), "final")
    got = {r.stream_id: (r.fresh_input, r.cache_read, r.output, r.outcome) for r in out}
    assert got == {"a": (10, 4, 7, "ok"), "b": (0, 0, 0, "incomplete_stream"), "c": (0, 0, 0, "empty_stream"), "d": (6, 3, 2, "ok")}


def test_recall_store_knows_and_evicts(spark, tmp_path):
    schema = "session string, content string"
    path = str(tmp_path / "in")
    rows = [("s", "one"), ("s", "one"), ("s", "two"), ("s", "x" * 50), ("t", "one")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    out = run(spark, responses.recall_store(spark.readStream.schema(schema).parquet(path), max_entries=2, max_bytes=40), "store")
    assert sorted(r.outcome for r in out if r.session == "s") == ["oversize", "seen", "stored", "stored"]
    handles = {r.handle for r in out if r.outcome == "stored"}
    assert len(handles) == 3 and all(h.startswith("r_") and len(h) == 45 for h in handles)


@pytest.mark.parametrize("body,want", [({"usage": {"input_tokens": 5, "output_tokens": 2}}, (5, 0, 0, 2)), ({}, (0, 0, 0, 0))])
def test_usage_shapes(body, want):
    assert tuple(responses.usage(body).values()) == want

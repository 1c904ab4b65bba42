"""Request bodies of three wire formats: detection, text segments, edits, attribution.

Bodies stay strings; segments are addressed by JSON pointers (RFC 6901) and edits are
applied once. Numbers and key order survive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tokenweir.functions import identity
from tokenweir.functions.jsontext import dumps, loads, parsed
from tokenweir.functions.lex import estimate

SEGMENT_SCHEMA = "request_id long, provider string, seg_ix int, ptr string, turn_ix int, role string, is_tool_result boolean, instruction boolean, frozen boolean, text string"
BLOCK_SCHEMA = "request_id long, block_ix int, zone string, section string, bucket string, tool_name string, role string, msg_index int, tokens long"


def provider_column(body: Column) -> Column:
    """The provider by top-level keys, then by a system message; null if nothing tells."""
    has = lambda *ks: F.arrays_overlap(F.json_object_keys(body), F.array(*map(F.lit, ks)))
    system = F.exists(F.from_json(F.get_json_object(body, "$.messages"), "array<struct<role:string>>"), lambda m: m["role"] == "system")
    return (
        F.when(has("contents", "systemInstruction", "system_instruction", "generationConfig", "generation_config"), "google")
        .when(has("system", "stop_sequences", "anthropic_version"), "anthropic")
        .when(has("input") & has("instructions", "max_output_tokens"), "openai")
        .when(has("max_completion_tokens", "response_format"), "openai")
        .when(system, "openai")
    )


def detect(body: dict) -> str | None:
    keys = set(body)
    if keys & {"contents", "systemInstruction", "system_instruction", "generationConfig", "generation_config"}:
        return "google"
    if keys & {"system", "stop_sequences", "anthropic_version"}:
        return "anthropic"
    if "input" in keys and keys & {"instructions", "max_output_tokens"} or keys & {"max_completion_tokens", "response_format"}:
        return "openai"
    if any(isinstance(m, dict) and m.get("role") == "system" for m in body.get("messages") or []):
        return "openai"
    return None


@dataclass
class Segment:
    ptr: str
    text: str
    turn: int
    role: str
    tool_result: bool = False
    instruction: bool = False
    frozen: bool = False


def escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def leaves(v, ptr: str) -> Iterator[tuple[str, str]]:
    """(pointer, text) of all string leaves below a value."""
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves(x, f"{ptr}/{escape(k)}")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from leaves(x, f"{ptr}/{i}")
    elif type(v) is str:
        yield ptr, v


def texts_of(content, ptr: str) -> Iterator[tuple[str, str, bool]]:
    """(pointer, text, is a tool result) of message content: a string or a list of blocks."""
    if type(content) is str:
        yield ptr, content, False
    for i, b in enumerate(content if isinstance(content, list) else []):
        at = f"{ptr}/{i}"
        if not isinstance(b, dict):
            continue
        kind = b.get("type")
        if type(b.get("text")) is str:
            yield f"{at}/text", b["text"], False
        if kind in ("tool_result", "web_search_tool_result"):
            yield from ((p, t, True) for p, t, _ in texts_of(b.get("content"), f"{at}/content"))
        elif kind == "document" and isinstance(b.get("source"), dict) and type(b["source"].get("data")) is str and b["source"].get("type") == "text":
            yield f"{at}/source/data", b["source"]["data"], False


def segments(body: dict, provider: str) -> list[Segment]:
    """Text segments in wire order, with cache freezing and instruction marks."""
    out: list[Segment] = []

    def system(content, ptr):
        out.extend(Segment(p, t, -1, "system", instruction=True) for p, t, _ in texts_of(content, ptr))

    if provider == "google":
        for name in ("systemInstruction", "system_instruction"):
            system((body.get(name) or {}).get("parts") if isinstance(body.get(name), dict) else None, f"/{name}/parts")
        for i, m in enumerate(body.get("contents") or []):
            role = "assistant" if m.get("role") == "model" else m.get("role") or "user"
            for k, part in enumerate(m.get("parts") or []):
                at = f"/contents/{i}/parts/{k}"
                if type(part.get("text")) is str:
                    out.append(Segment(f"{at}/text", part["text"], i, role))
                if "functionResponse" in part:
                    out.extend(Segment(p, t, i, role, True) for p, t in leaves(part["functionResponse"].get("response"), f"{at}/functionResponse/response"))
        return out
    system(body.get("system"), "/system")
    if type(body.get("instructions")) is str:
        out.append(Segment("/instructions", body["instructions"], -1, "system", instruction=True))
    name = "messages" if "messages" in body else "input"
    rows = body.get(name)
    if type(rows) is str:
        return [*out, Segment(f"/{name}", rows, 0, "user")]
    for i, m in enumerate(rows or []):
        role = m.get("role") or ("tool" if str(m.get("type", "")).endswith("_output") else "user")
        rule = role in ("system", "developer")
        out.extend(Segment(p, t, i, role, r or role == "tool", rule) for p, t, r in texts_of(m.get("content"), f"/{name}/{i}/content"))
        if type(m.get("output")) is str:
            out.append(Segment(f"/{name}/{i}/output", m["output"], i, "tool", True))
    marked = max([i for i, m in enumerate(rows or []) if _marked(m)], default=-1)
    sys_marked = _marked(body.get("system"))
    for s in out:
        s.frozen = (s.turn >= 0 and s.turn <= marked) or (s.turn < 0 and s.ptr.startswith("/system") and (sys_marked or marked >= 0))
    return out


def _marked(v) -> bool:
    if isinstance(v, dict):
        return "cache_control" in v or any(_marked(x) for x in v.values())
    return isinstance(v, list) and any(map(_marked, v))


def first_arrivals(body: dict, segs: list[Segment]) -> list[Segment]:
    """Tool results of the last message, where that message carries the cache mark."""
    rows = body.get("messages") or []
    if not rows or not _marked(rows[-1]):
        return []
    last = max((i for i, m in enumerate(rows) if m.get("role") not in ("system", "developer")), default=-1)
    return [s for s in segs if s.turn == last and s.tool_result]


def assign(body, ptr: str, text: str) -> bool:
    """Sets the string at a pointer; False if nothing is there."""
    parts = [p.replace("~1", "/").replace("~0", "~") for p in ptr.split("/")[1:]]
    at = body
    for k, p in enumerate(parts):
        try:
            key = int(p) if isinstance(at, list) else p
            if k == len(parts) - 1:
                at[key]
                at[key] = text
                return True
            at = at[key]
        except (KeyError, IndexError, ValueError, TypeError):
            return False
    return False


def tools_of(body: dict, provider: str) -> list[dict]:
    """name, description, schema and a reference to each tool's own object."""
    out = []
    for t in body.get("tools") or []:
        if not isinstance(t, dict):
            continue
        if provider == "google":
            out += [{"name": f.get("name", ""), "ref": f, "schema": "parameters"} for f in t.get("functionDeclarations") or t.get("function_declarations") or []]
        elif isinstance(t.get("function"), dict):
            out.append({"name": t["function"].get("name", ""), "ref": t["function"], "schema": "parameters"})
        else:
            out.append({"name": t.get("name", ""), "ref": t, "schema": "input_schema" if "input_schema" in t else "parameters"})
    return out


def add_instruction(body: dict, provider: str, text: str) -> None:
    """Appends a system text in the provider's own shape."""
    if provider == "google":
        name = "system_instruction" if "system_instruction" in body else "systemInstruction"
        body.setdefault(name, {"parts": []}).setdefault("parts", []).append({"text": text})
    elif provider == "anthropic":
        old = body.get("system")
        if isinstance(old, list):
            old.append({"type": "text", "text": text})
        else:
            body["system"] = f"{old}\n\n{text}" if old else text
    elif "input" in body:
        body["instructions"] = f"{body['instructions']}\n\n{text}" if body.get("instructions") else text
    else:
        rows = body.setdefault("messages", [])
        if rows and rows[0].get("role") in ("system", "developer") and type(rows[0].get("content")) is str:
            rows[0]["content"] += "\n\n" + text
        else:
            rows.insert(0, {"role": "system", "content": text})


def count(v) -> int:
    return 0 if v is None else estimate(v if type(v) is str else dumps(v))


def attribute(body: dict, provider: str) -> list[tuple]:
    """(zone, section, bucket, tool_name, role, msg_index, tokens) per block with tokens."""
    out: list[tuple] = []

    def put(section, bucket, v, tool=None, role=None, ix=None):
        n = count(v)
        if n:
            out.append(("input", section, bucket, tool, role, ix, n))

    if provider == "google":
        for name in ("systemInstruction", "system_instruction"):
            for part in (body.get(name) or {}).get("parts") or []:
                put("static", "system", part.get("text"))
    else:
        content = body.get("system") if provider == "anthropic" else body.get("instructions")
        for _, t, _ in texts_of(content, ""):
            put("static", "system", t)
    for t in tools_of(body, provider):
        put("static", "schema", t["ref"], t["name"])
    names: dict[str, str] = {}
    rows = body.get("contents") if provider == "google" else body.get("messages", body.get("input"))
    for i, m in enumerate(rows if isinstance(rows, list) else []):
        role = {"model": "assistant"}.get(m.get("role"), m.get("role"))
        if role in ("system", "developer"):
            for _, t, _ in texts_of(m.get("content"), ""):
                put("static", "system", t)
            continue
        kind = str(m.get("type", ""))
        if kind in ("function_call", "custom_tool_call"):
            names[m.get("call_id", "")] = m.get("name", "")
            put("messages", "tool_use", m, m.get("name"), "assistant", i)
            continue
        if kind.endswith("_output"):
            put("messages", "tool_result", m.get("output"), names.get(m.get("call_id", "")), "user", i)
            continue
        for c in m.get("tool_calls") or []:
            f = c.get("function") or {}
            names[c.get("id", "")] = f.get("name", "")
            put("messages", "tool_use", c, f.get("name"), "assistant", i)
        parts = m.get("parts") if provider == "google" else m.get("content")
        if type(parts) is str:
            parts = [{"type": "text", "text": parts}]
        for b in parts or []:
            if "functionCall" in b:
                put("messages", "tool_use", b["functionCall"], b["functionCall"].get("name"), role, i)
            elif "functionResponse" in b:
                put("messages", "tool_result", b["functionResponse"].get("response"), b["functionResponse"].get("name"), role, i)
            elif b.get("type") in ("tool_use", "server_tool_use"):
                names[b.get("id", "")] = b.get("name", "")
                put("messages", "tool_use", b, b.get("name"), role, i)
            elif b.get("type") in ("tool_result", "web_search_tool_result"):
                put("messages", "tool_result", "\n".join(t for _, t, _ in texts_of(b.get("content"), "")), names.get(b.get("tool_use_id", "")), role, i)
            elif b.get("type") in ("thinking", "redacted_thinking"):
                put("messages", "thinking", b.get("thinking") or b.get("data"), None, role, i)
            elif role == "tool":
                put("messages", "tool_result", b.get("text"), names.get(m.get("tool_call_id", "")), "user", i)
            else:
                put("messages", "text", b.get("text"), None, role, i)
    return out


def system_text(body: dict, provider: str) -> str | None:
    """All system texts of a request, a line break after each; null if it has none.

    A field of its own (system, instructions, system instruction) goes before messages.
    """
    names = {"anthropic": ["system"], "google": ["systemInstruction", "system_instruction"]}.get(provider, ["instructions"])
    field = next((body[n] for n in names if n in body), None)
    if field is not None:
        return flat_text(field.get("parts", field) if isinstance(field, dict) else field)
    rows = body.get("messages") or body.get("input")
    said = [m for m in (rows if isinstance(rows, list) else []) if isinstance(m, dict) and m.get("role") in ("system", "developer") and m.get("type") in (None, "message")]
    return "".join(flat_text(m.get("content", m)) for m in said) or None


def flat_text(v) -> str:
    """Strings and the `text` of blocks, a line break after each."""
    parts = v if isinstance(v, list) else [v]
    texts = (p.get("text") if isinstance(p, dict) else p for p in parts)
    return "".join(t + "\n" for t in texts if type(t) is str)


def identities(requests: DataFrame) -> DataFrame:
    """request_id, session_id, agent, project of requests (request_id, body), from their system texts.

    Nulls where a body can't be read or has no system text.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [parsed(t or "") for t in batch.body]
            yield pd.DataFrame({"request_id": batch.request_id, "system": [system_text(b, detect(b) or "openai") if isinstance(b, dict) else None for b in bodies]})

    said = requests.select("request_id", "body").mapInPandas(work, "request_id long, system string")
    s = F.col("system")
    return said.select("request_id", identity.fnv1a_hex(s).alias("session_id"), identity.agent(s).alias("agent"), identity.directory(s).alias("project"))


def extract_segments(requests: DataFrame) -> DataFrame:
    """Segments of requests (request_id, body); bodies that can't be read give none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rid, text in zip(batch.request_id, batch.body):
                body = parsed(text or "")
                provider = detect(body) or "openai" if isinstance(body, dict) else None
                for k, s in enumerate(segments(body, provider) if provider else []):
                    rows.append((rid, provider, k, s.ptr, s.turn, s.role, s.tool_result, s.instruction, s.frozen, s.text))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in SEGMENT_SCHEMA.split(", ")])

    return requests.select("request_id", "body").mapInPandas(work, SEGMENT_SCHEMA)


def apply_edits(requests: DataFrame, edits: DataFrame) -> DataFrame:
    """Bodies with the texts of edits (request_id, ptr, text) in place, all at once per request."""
    packed = edits.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("ptr", "text"))).alias("edits"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, changes in zip(batch.body, batch.edits):
                body = parsed(text or "")
                if body is None or changes is None:
                    out.append(text)
                    continue
                for ptr, new in dict(changes).items():
                    assign(body, ptr, new)
                out.append(dumps(body))
            yield pd.DataFrame({"request_id": batch.request_id, "body": out})

    return requests.join(packed, "request_id", "left").select("request_id", "body", "edits").mapInPandas(work, "request_id long, body string")


def attribute_blocks(requests: DataFrame) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rid, text in zip(batch.request_id, batch.body):
                body = parsed(text or "")
                if isinstance(body, dict):
                    rows += [(rid, k, *b) for k, b in enumerate(attribute(body, detect(body) or "openai"))]
            df = pd.DataFrame(rows, columns=[x.split(" ")[0] for x in BLOCK_SCHEMA.split(", ")])
            df["msg_index"] = df["msg_index"].astype("Int32")
            yield df

    return requests.select("request_id", "body").mapInPandas(work, BLOCK_SCHEMA)


def from_conversations(conversations: DataFrame) -> DataFrame:
    """A request body per conversation, its turns as messages.

    The turns are dealt out to an explicit number of partitions, the session's: what follows
    is heavy per request, and adaptive execution would join partitions that are small in bytes.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conversations = conversations.select(F.col("conv_id").alias("request_id"), "turn", "role", "text").repartition(parts, "request_id")
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    messages = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return conversations.groupBy("request_id").agg(F.to_json(F.struct(F.lit("m1").alias("model"), messages.alias("messages"))).alias("body"))


def parse_body(text: str):
    return loads(text)

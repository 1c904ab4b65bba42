"""The compression pipeline over a table of requests.

Requests don't depend on one another, so the whole gated stage list runs in one Arrow map
without a shuffle; a request's size bounds what a worker holds. Each content stage is kept
only if it lowers the request's estimated tokens, lossy ones only if enough of what the
question needs survives.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tokenweir.config import PRESETS, Config, preset as preset_of
from tokenweir.functions import codetext, folding, jsontext as J, phrases, selecting
from tokenweir.functions.lex import content_words, estimate, lines, words
from tokenweir.functions.tokens import byte_pairs
from tokenweir.sources import requests as R

SCHEMA = (
    "request_id long, provider string, preset string, tokens_before long, tokens_after long, body string, "
    "stages array<struct<stage:string,applied:boolean,tokens_before:bigint,tokens_after:bigint,note:string>>"
)
COVERAGE = 0.5
# The system texts that stages add, in our own words.
LEGEND = "Record tables: a head line [rows]{columns}: or a CSV head line names the columns, then one line per record."
SAMPLED = "Long record lists were sampled; _sampled_from_<field> gives the number of records before. Original sizes: "
OUTPUT = {
    "terse": "Answer briefly: no preamble, no repetition of the question, no summary.",
    "draft": "Think in short notes of at most five words a step, then give the final answer.",
    "frugal": "Call a tool only if the answer needs it, and don't repeat a call.",
    "direct": "Don't deliberate over what is plain; go straight to the answer.",
    "language": "Answer in the language of the question.",
}
DIRECTIVE = re.compile(r"<(instructions|rules|constraints|system-reminder|important)>.*?</\1>", re.S)


class Request:
    """A parsed body with its provider; edits go through `set`.

    Segments are listed once between changes, and texts are counted and split once each:
    most stages leave most texts as they are.
    """

    def __init__(self, body: dict, provider: str, counter: Callable[[str], int] | None = None):
        self.body, self.provider = body, provider
        self.counter = counter or estimate
        self.counts: dict[str, int] = {}
        self.split: dict[str, list[str]] = {}
        self._held: list[R.Segment] | None = None

    def segments(self, all_of: bool = False) -> list[R.Segment]:
        if self._held is None:
            self._held = R.segments(self.body, self.provider)
        return self._held if all_of else [s for s in self._held if not s.frozen and not s.instruction]

    def set(self, seg: R.Segment, text: str) -> None:
        if text != seg.text:
            R.assign(self.body, seg.ptr, text)
            self._held = None

    def changed(self, body: dict | None = None) -> None:
        """Called after edits that don't go through `set`, with the body to go back to if any."""
        self.body = self.body if body is None else body
        self._held = None

    def words(self, text: str) -> list[str]:
        if text not in self.split:
            self.split[text] = words(text)
        return self.split[text]

    def count(self, text: str) -> int:
        if text not in self.counts:
            self.counts[text] = self.counter(text)
        return self.counts[text]

    def tokens(self) -> int:
        content = sum(self.count(s.text) for s in self.segments(True))
        return content + (self.count(J.dumps(self.body["tools"])) if self.body.get("tools") else 0)

    def question(self) -> list[str]:
        """Words of the last user turn if it is short."""
        mine = [s for s in self.segments(True) if s.role == "user" and not s.tool_result]
        last = [s for s in mine if s.turn == max(x.turn for x in mine)] if mine else []
        text = " ".join(s.text for s in last)
        return self.words(text) if len(text) < 600 else []


def clone(v):
    """The containers of a body anew; texts and numbers don't change and are shared."""
    if isinstance(v, dict):
        return {k: clone(x) for k, x in v.items()}
    return [clone(x) for x in v] if isinstance(v, list) else v


def coverage(source: str, kept: str, query: list[str]) -> float:
    q, s, k = set(query), words(source), words(kept)
    uni = q.intersection(s)
    bi = {p for p in zip(s, s[1:]) if q.intersection(p)}
    total = len(uni) + len(bi)
    return (len(uni.intersection(k)) + len(bi.intersection(zip(k, k[1:])))) / total if total else 1.0


class Automaton:
    """A suffix automaton over words: any walk from its start is a run of the source."""

    def __init__(self, ws: list[str]):
        self.next: list[dict[str, int]] = [{}]
        length, link, last = [0], [-1], 0
        for w in ws:
            cur, p = len(self.next), last
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][w]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


def density(source: str, kept: str) -> float:
    """Mean length of the longest runs of kept words that stand in the source, greedily."""
    s, k = words(source), words(kept)
    if not s or not k:
        return 0.0
    steps = Automaton(s).next
    found, i = [], 0
    while i < len(k):
        state = n = 0
        while i + n < len(k) and k[i + n] in steps[state]:
            state = steps[state][k[i + n]]
            n += 1
        found.append(n)
        i += max(1, n)
    return sum(found) / len(found)


def calibrate(scores: list[tuple[float, bool]], alpha: float = 0.1, recall: float = 0.9) -> float:
    """Split-conformal threshold on coverage: the level that few bad cuts exceed."""
    bad = sorted(s for s, kept in scores if not kept)
    if not bad:
        return 0.0
    n = len(bad)
    rank = min(max(-(-int((n + 1) * (1 - alpha) * 1_000_000) // 1_000_000), 1), n)
    level = min(1.0, bad[rank - 1] + 2.220446049250313e-16)
    accepted = [kept for s, kept in scores if s >= level]
    return level if accepted and sum(accepted) / len(accepted) >= recall else max(level, bad[-1])


# ---- stages: each changes the request and returns a note or None ----


def stage_toolout(r: Request, c: Config) -> str | None:
    segs = r.segments()
    size = [len(lines(s.text)) for s in segs]
    query = {w for s, n in zip(segs, size) if n < c.toolout_min_lines for w in r.words(s.text)}
    seen: set[str] = set()
    for s, n in zip(segs, size):
        if n < c.toolout_min_lines:
            continue  # too short to be shaped, and to repeat what is long enough
        shape = "\n".join(folding.template(x)[0] for x in lines(s.text))
        again = shape in seen
        seen.add(shape)
        if again:
            continue
        new = folding.shape(s.text, query, c.toolout_min_lines, c.toolout_max_lines)
        if new is not None and len(new) < len(s.text):
            r.set(s, new)
    return None


def stage_retrieve(r: Request, c: Config) -> str | None:
    segs, query = r.segments(), [w for w in r.question() if len(w) > 1]
    users = [s.turn for s in segs if s.role == "user"]
    last = max(users, default=-1) if len({s.turn for s in segs}) > 1 else -2
    for s in segs:
        if s.turn == last or len(s.text) < c.retrieve_min_chars or J.parsed(s.text) is not None:
            continue
        out, at = [], 0
        for m in [*DIRECTIVE.finditer(s.text), None]:
            gap = s.text[at : m.start() if m else len(s.text)]
            out.append(prune(gap, query, c) if len(gap) >= c.retrieve_min_chars else gap)
            if m:
                out.append(m[0])
                at = m.end()
        r.set(s, "".join(out))
    return None


def prune(text: str, query: list[str], c: Config) -> str:
    q = content_words(" ".join(query))
    if c.retrieve_sentence:
        parts = selecting.sentences(text)
        return selecting.rebuild(parts, selecting.prune_sentences(parts, q, c.retrieve_ratio)) if len(parts) > 2 else text
    parts = selecting.chunks_of(text)
    return selecting.rebuild(parts, selecting.prune_chunks(parts, q, c.retrieve_ratio)) if len(parts) > 2 else text


def stage_skeleton(r: Request, c: Config) -> str | None:
    query = {t for w in r.question() for t in codetext.subtokens(w)}
    for s in r.segments():
        r.set(s, codetext.in_fences(s.text, lambda code, lang: codetext.skeleton(code, lang, query, c.skeleton_full, c.skeleton_drop)))
    return None


def stage_minify_code(r: Request, c: Config) -> str | None:
    for s in r.segments():
        r.set(s, codetext.in_fences(s.text, codetext.minify))
    return None


def stage_image(r: Request, c: Config) -> str | None:
    """Sets the detail tier that the configuration asks for (`low` is lossy and costs a flat price); none leaves it.

    Pixels stay: scaling embedded images needs an image library.
    """
    if not c.image_detail or r.provider != "openai":
        return None
    marked = 0
    for m in r.body.get("messages") or r.body.get("input") or []:
        for b in m.get("content") if isinstance(m, dict) and isinstance(m.get("content"), list) else []:
            if isinstance(b, dict) and b.get("type") == "image_url" and isinstance(b.get("image_url"), dict):
                b["image_url"]["detail"] = c.image_detail
                marked += 1
            elif isinstance(b, dict) and b.get("type") == "input_image":
                b["detail"] = c.image_detail
                marked += 1
    return f"{marked} images" if marked else None


def stage_hygiene(r: Request, c: Config) -> str | None:
    for s in r.segments():
        r.set(s, J.hygiene(s.text, c.strip_base64, c.normalize_unicode, c.numeric_digits or None))
    return None


def stage_crush(r: Request, c: Config) -> str | None:
    query = {w for s in r.segments() if len(s.text) < 600 and len(lines(s.text)) < 4 for w in r.words(s.text)}
    sizes = []
    for s in r.segments():
        v = J.parsed(s.text)
        out = J.crush(v, c.json_crush_rows, query) if v is not None else None
        if out:
            r.set(s, J.dumps(out[0]))
            sizes.append(out[1])
    if sizes:
        R.add_instruction(r.body, r.provider, SAMPLED + ", ".join(map(str, sizes)) + ".")
    return None


def stage_serialize(r: Request, c: Config) -> str | None:
    routes = []
    for s in r.segments():
        v = J.parsed(s.text)
        out = J.encode(v, c.serialize_min_rows, c.serialize_flatten, c.serialize_csv, c.serialize_buckets, c.serialize_nested) if v is not None else None
        if out and r.count(out[0]) < r.count(s.text):
            r.set(s, out[0])
            routes.append(out[1])
    if routes:
        R.add_instruction(r.body, r.provider, LEGEND)
    return ",".join(routes) or None


def stage_dedup(r: Request, c: Config) -> str | None:
    for s in r.segments():
        r.set(s, folding.dedup_adjacent(s.text) if J.is_structured(s.text) else folding.dedup(s.text, c.dedup_near, c.dedup_distance))
    return None


def stage_ngram(r: Request, c: Config) -> str | None:
    segs = [s for s in r.segments() if not J.is_structured(s.text) and "```" not in s.text]
    new, glossary = phrases.mine([s.text for s in segs], c.ngram_entries)
    for s, text in zip(segs, new):
        r.set(s, text)
    if glossary:
        R.add_instruction(r.body, r.provider, "Abbreviations:\n" + "\n".join(f"{a}={b}" for a, b in glossary))
    return f"{len(glossary)} phrases" if glossary else None


def stage_tools(r: Request, c: Config) -> str | None:
    tools = R.tools_of(r.body, r.provider)
    turns = {s.turn for s in r.segments(True) if not s.instruction}
    called = any(s.tool_result for s in r.segments(True))
    if c.tool_select and tools and len(turns) <= 1 and not called:
        text = " ".join(s.text for s in r.segments(True))
        query = content_words(text)
        docs = [" ".join([(t["name"].replace("_", " ") + " ") * 4, (" ".join((t["ref"].get(t["schema"]) or {}).get("properties", {})) + " ") * 2, str(t["ref"].get("description", ""))]) for t in tools]
        scores = selecting.bm25(docs, query, delta=0.0)
        keep = [s > 0 or bool(re.search(rf"(?<!\w){re.escape(t['name'])}(?!\w)", text)) for s, t in zip(scores, tools)]
        if any(keep) and not all(keep):
            gone = {id(t["ref"]) for t, k in zip(tools, keep) if not k}
            if r.provider == "google":
                for t in r.body["tools"]:
                    for name in ("functionDeclarations", "function_declarations"):
                        if name in t:
                            t[name] = [f for f in t[name] if id(f) not in gone]
            else:
                r.body["tools"] = [t for t in r.body["tools"] if id(t.get("function", t)) not in gone and id(t) not in gone]
    for t in R.tools_of(r.body, r.provider):
        if c.tool_trim and isinstance(t["ref"].get("description"), str):
            t["ref"]["description"] = J.trim_description(t["ref"]["description"], c.tool_chars)
        if c.tool_minify and isinstance(t["ref"].get(t["schema"]), dict):
            t["ref"][t["schema"]] = J.minify_schema(t["ref"][t["schema"]], c.tool_chars)
    return None


def stage_output(r: Request, c: Config) -> str | None:
    said = [OUTPUT[c.output_level]] if c.output else []
    if c.output_frugal and r.body.get("tools"):
        said.append(OUTPUT["frugal"])
    if c.output_direct:
        said.append(OUTPUT["direct"])
    if c.output_budget:
        said.append(f"Use at most {c.output_budget} tokens.")
    prose = " ".join(s.text for s in r.segments(True) if s.role == "user")
    if said and any(ch.isalpha() and ord(ch) > 127 for ch in prose):
        said.append(OUTPUT["language"])
    shaped = "response_format" in r.body or r.body.get("tool_choice") not in (None, "auto", "none")
    if said and not shaped:
        R.add_instruction(r.body, r.provider, " ".join(said))
    name = {"anthropic": "max_tokens", "openai": "max_completion_tokens"}.get(r.provider)
    if c.output_max_tokens and name and not {"max_tokens", "max_completion_tokens", "max_output_tokens"} & set(r.body):
        r.body[name] = J.Number(c.output_max_tokens)
    return None


def stage_cache(r: Request, c: Config) -> str | None:
    """Tools in name order with sorted keys, and cache marks on tools, system and last block."""
    if r.provider == "openai" and not r.body.get("prompt_cache_key"):
        r.body["prompt_cache_key"] = prefix_key(r)
    if R._marked(r.body.get("messages")) or R._marked(r.body.get("system")) or R._marked(r.body.get("tools")):
        return "marked by the client"
    if isinstance(r.body.get("tools"), list):
        r.body["tools"] = sorted((sort_keys(t) for t in r.body["tools"]), key=lambda t: J.dumps(t.get("name", t.get("function", {}).get("name", ""))))
    if r.provider != "anthropic":
        return None
    mark, left = {"type": "ephemeral"}, c.cache_marks
    if r.body.get("tools") and left:
        r.body["tools"][-1]["cache_control"] = mark
        left -= 1
    system = r.body.get("system")
    if type(system) is str and system and left:
        r.body["system"] = [{"type": "text", "text": system, "cache_control": mark}]
        left -= 1
    rows = r.body.get("messages") or []
    if len(rows) >= 2 and left:
        content = rows[-1].get("content")
        if type(content) is str:
            rows[-1]["content"] = [{"type": "text", "text": content, "cache_control": mark}]
        elif isinstance(content, list) and content and isinstance(content[-1], dict):
            content[-1]["cache_control"] = mark
    return None


def sort_keys(v):
    if isinstance(v, dict):
        return {k: sort_keys(v[k]) for k in sorted(v)}
    return [sort_keys(x) for x in v] if isinstance(v, list) else v


def prefix_key(r: Request) -> str:
    """A name for what requests of one application have in common: system texts and tools."""
    from tokenweir.functions.lex import fnv1a

    head = [s.text for s in r.segments(True) if s.instruction]
    return f"{fnv1a(chr(31).join([*head, J.dumps(r.body.get('tools'))]).encode()):016x}"


#: (name, setting, gate, function); gates: tokens, quality (tokens and coverage), always.
STAGES: list[tuple[str, str, str, Callable[[Request, Config], str | None]]] = [
    ("toolout", "toolout", "quality", stage_toolout),
    ("retrieve", "retrieve", "quality", stage_retrieve),
    ("skeleton", "skeleton", "tokens", stage_skeleton),
    ("minify-code", "minify_code", "tokens", stage_minify_code),
    ("image", "image", "always", stage_image),
    ("hygiene", "hygiene", "tokens", stage_hygiene),
    ("json-crush", "json_crush", "tokens", stage_crush),
    ("serialize", "serialize", "tokens", stage_serialize),
    ("dedup", "dedup", "tokens", stage_dedup),
    ("ngram", "ngram", "tokens", stage_ngram),
    ("tools", "tool_select tool_trim tool_minify", "tokens", stage_tools),
    ("output", "output output_frugal output_direct output_budget output_max_tokens", "always", stage_output),
    ("cache", "cache", "always", stage_cache),
]


def route(r: Request) -> str:
    if r.body.get("tools"):
        return "agent"
    texts = [s.text for s in r.segments(True)]
    if any("```" in t for t in texts):
        return "code"
    turns = max([len(r.body[k]) for k in ("messages", "input", "contents") if isinstance(r.body.get(k), list)], default=0)
    return "rag" if turns >= 2 and any(len(t) >= 1200 for t in texts) else "aggressive"


def run(r: Request, c: Config) -> list[tuple]:
    """Runs the enabled stages with their gates; returns a report row per stage."""
    report = []
    now = r.tokens()
    for name, setting, gate, stage in STAGES:
        if not any(getattr(c, s) for s in setting.split()):
            continue
        kept = clone(r.body)
        note = None
        context = lambda: "\n".join(s.text for s in r.segments(True) if s.role != "user" or len(s.text) >= 600)
        query = r.question() if gate == "quality" else []
        source = context() if query else ""
        try:
            note = stage(r, c)
            if gate == "always" or r.body != kept:
                r.changed()
                after = r.tokens()
            else:
                after = now
            applied = gate == "always" or after < now
            if applied and query and coverage(source, context(), query) < COVERAGE:
                applied, note = False, "coverage"
        except (ValueError, KeyError, TypeError, AttributeError, IndexError, RecursionError) as e:
            applied, after, note = False, now, f"error: {type(e).__name__}"
        if not applied:
            r.changed(kept)
            after = now
        report.append((name, applied, now, after, note))
        now = after
    return report


def compress_body(text: str, name: str = "auto", config: Config | None = None, provider: str | None = None, counter=None) -> dict:
    """One request: provider, preset, tokens before and after, new body, stage reports.

    `provider` names the wire format where the body itself may not tell; without it such a body is refused.
    `counter` counts the tokens of a text for the gates; by default they are estimated.
    """
    body = J.parsed(text or "")
    if not isinstance(body, dict):
        raise ValueError("the request is not a JSON object")
    kind = provider or R.detect(body)
    if kind is None:
        raise ValueError("the wire format can't be told from the body; name the provider")
    r = Request(body, kind, counter)
    c = config or preset_of(name)
    if c.auto:
        name = route(r)
        c = preset_of(name)
    before = r.tokens()
    stages = run(r, c)
    after = r.tokens()
    if after >= before and not any(s[1] and (s[0] in ("output", "cache") or s[0] == "image" and s[4]) for s in stages):
        return {"provider": r.provider, "preset": name, "before": before, "after": before, "body": text, "stages": stages}
    return {"provider": r.provider, "preset": name, "before": before, "after": after, "body": J.dumps(r.body), "stages": stages}


def compress(requests: DataFrame, preset: str = "auto", config: Config | None = None, provider: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Compressed requests (request_id, body).

    Bodies that can't be read, or whose wire format neither they nor `provider` tell, come
    back unchanged, with a null provider and no stages. With `ranks_path`, a vocabulary file
    that executors can open, the gates count exact byte pairs; else they estimate.
    """
    if config is None and preset.lower() not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = byte_pairs(ranks_path) if ranks_path else None
        for batch in batches:
            rows = []
            for rid, text in zip(batch.request_id, batch.body):
                try:
                    d = compress_body(text, preset, config, provider, counter)
                    stages = [dict(zip(("stage", "applied", "tokens_before", "tokens_after", "note"), s)) for s in d["stages"]]
                    rows.append((rid, d["provider"], d["preset"], d["before"], d["after"], d["body"], stages))
                except ValueError:
                    n = (counter or estimate)(text or "")
                    rows.append((rid, None, preset, n, n, text, []))
            yield pd.DataFrame(rows, columns=["request_id", "provider", "preset", "tokens_before", "tokens_after", "body", "stages"])

    return requests.select("request_id", "body").mapInPandas(work, SCHEMA)


def compress_text(texts: DataFrame, preset: str = "safe") -> DataFrame:
    """Plain texts (id, text) as one-message requests; returns id, text, tokens before and after."""
    body = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))).alias("messages")))
    out = compress(texts.select(F.col("id").alias("request_id"), body.alias("body")), preset, provider="openai")
    content = F.from_json("body", "messages array<struct<role:string,content:string>>")["messages"]
    return out.select(F.col("request_id").alias("id"), F.element_at(content, -1)["content"].alias("text"), "tokens_before", "tokens_after")


def stage_report(compressed: DataFrame) -> DataFrame:
    """Requests, applications and tokens saved per stage."""
    s = compressed.select(F.explode("stages").alias("s")).select("s.*")
    return s.groupBy("stage").agg(F.count("*").alias("requests"), F.count_if("applied").alias("applied"), F.sum(F.col("tokens_before") - F.col("tokens_after")).alias("saved"))


def rehydrate(text: str) -> str:
    """Nothing in a compressed answer needs undoing: JSON is written compactly, else the text is given back."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return text

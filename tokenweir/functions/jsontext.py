"""JSON inside texts: exact numbers and key order, compact forms, record tables, sampling."""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
from collections import Counter, defaultdict

from tokenweir.functions.lex import lines, words
from tokenweir.functions.selecting import celf, pairs

_ERROR = re.compile(r"(?i)\b(error|fail(?:ed|ure)?|fatal|exception|critical)\b")


class Number(str):
    """A number as it is written."""


def loads(text: str):
    return json.loads(text, parse_float=Number, parse_int=Number)


def dumps(v) -> str:
    if isinstance(v, Number):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dumps, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def parsed(text: str):
    """The value of a text that is an object or array, else None."""
    if text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        return loads(text)
    except ValueError:
        return None


def minify(text: str) -> str:
    """The whole text if it is JSON, else fenced blocks and balanced spans in it."""
    v = parsed(text)
    if v is not None:
        return dumps(v)
    out, at = [], 0
    while at < min(len(text), 1 << 18):
        m = re.compile(r"[\[{]").search(text, at)
        if not m:
            break
        end = balanced_end(text, m.start())
        v = parsed(text[m.start() : end]) if end else None
        if v is None or end - m.start() < 8:
            out.append(text[at : m.start() + 1])
            at = m.start() + 1
        else:
            out.append(text[at : m.start()] + dumps(v))
            at = end
    return "".join(out) + text[at:]


def balanced_end(text: str, at: int) -> int | None:
    depth, quoted, i = 0, False, at
    while i < len(text) and i < at + (1 << 18):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return None


def scrub_base64(text: str, least: int = 200) -> str:
    mark = lambda m: f"[base64 elided: {len(m[0])} chars]"
    text = re.sub(r"data:[\w.+/-]+;base64,[A-Za-z0-9+/=]+", mark, text)
    return re.sub(rf"[A-Za-z0-9+/]{{{least},}}={{0,2}}", mark, text)


def normal_unicode(text: str) -> str:
    text = re.sub("[   　 ]", " ", text)
    return unicodedata.normalize("NFKC", re.sub("[​‌‍﻿]", "", text))


def round_numbers(v, digits: int):
    """Fractions with the given number of significant digits; whole numbers as they are."""
    if isinstance(v, dict):
        return {k: round_numbers(x, digits) for k, x in v.items()}
    if isinstance(v, list):
        return [round_numbers(x, digits) for x in v]
    if isinstance(v, Number) and re.search(r"[.eE]", v):
        x = float(v)
        return v if x == int(x) else Number(f"{x:.{digits}g}")
    return v


def scalar(v) -> bool:
    return not isinstance(v, (dict, list))


def records(v) -> bool:
    return isinstance(v, list) and bool(v) and all(isinstance(r, dict) and r for r in v)


def flatten(rows: list[dict]) -> list[dict] | None:
    """Nested objects as dotted columns; None where there is an array or a name clash."""

    def walk(row: dict, prefix: str, out: dict) -> bool:
        for k, v in row.items():
            name = prefix + k
            if isinstance(v, dict) and v:
                if not walk(v, name + ".", out):
                    return False
            elif isinstance(v, list) or name in out:
                return False
            else:
                out[name] = v
        return True

    flat: list[dict] = [{} for _ in rows]
    if not any(isinstance(v, dict) for r in rows for v in r.values()):
        return None
    return flat if all(walk(r, "", f) for r, f in zip(rows, flat)) else None


def _cell(v, seps: str) -> str:
    if v is None:
        return "null"
    s = dumps(v) if not isinstance(v, str) or isinstance(v, Number) else v
    plain = isinstance(v, str) and not isinstance(v, Number)
    if plain and (s == "" or s != s.strip() or any(c in s for c in seps) or re.fullmatch(r"true|false|null|-?[\d.].*", s)):
        return json.dumps(s, ensure_ascii=False)
    return s


def to_toon(rows: list[dict]) -> str:
    """`[N]{f1,f2}:` and a line per record; texts that could be misread are quoted."""
    keys = list(rows[0])
    head = f"[{len(rows)}]{{{','.join(_cell(k, ',:{}') for k in keys)}}}:"
    return "\n".join([head, *("  " + ",".join(_cell(r[k], ',:"\\\n') for k in keys) for r in rows)])


def from_toon(text: str) -> list[dict]:
    """The records of to_toon's text."""

    def cells(line: str) -> list[str]:
        return re.findall(r'"(?:[^"\\]|\\.)*"|[^,]+', line)

    def value(c: str):
        if c.startswith('"'):
            return json.loads(c)
        return {"true": True, "false": False, "null": None}.get(c, Number(c) if re.fullmatch(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", c) else c)

    ls = text.split("\n")
    keys = [value(c) for c in cells(re.fullmatch(r"\[\d+\]\{(.*)\}:", ls[0])[1])]
    return [dict(zip(map(str, keys), map(value, cells(x.strip())))) for x in ls[1:]]


def union_keys(rows: list[dict]) -> list[str]:
    """All keys, most frequent first, then by name."""
    n = Counter(k for r in rows for k in r)
    return sorted(n, key=lambda k: (-n[k], k))


def to_csv(rows: list[dict]) -> str:
    keys, out = union_keys(rows), io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(keys)
    for r in rows:
        w.writerow(["" if r.get(k) is None else r[k] if isinstance(r[k], str) else dumps(r[k]) for k in keys])
    return out.getvalue().rstrip("\n")


def columnar(rows: list[dict]) -> bool:
    """Scalar values only, and at least half of the keys in four fifths of the rows."""
    n = Counter(k for r in rows for k in r)
    return all(scalar(v) for r in rows for v in r.values()) and 2 * sum(c * 5 >= 4 * len(rows) for c in n.values()) >= len(n)


def encode(v, min_rows: int = 2, flat: bool = True, as_csv: bool = True, buckets: bool = True, nested: bool = True) -> tuple[str, str] | None:
    """(text, route) of the shortest fitting table form of a JSON value, or None.

    Routes in order: uniform records (TOON, or CSV where that is not longer), near-uniform
    CSV, a table per key set, tables inside of the value.
    """
    if records(v) and len(v) >= min_rows:
        rows = (flatten(v) if flat else None) or v
        uniform = len({tuple(sorted(r)) for r in rows}) == 1 and all(scalar(x) for r in rows for x in r.values())
        if uniform:
            toon, table = to_toon(rows), to_csv(rows)
            return (table, "csv") if as_csv and len(table.encode()) <= len(toon.encode()) else (toon, "toon")
        if columnar(rows):
            return to_csv(rows), "csv"
        groups = defaultdict(list)
        for r in rows:
            groups[tuple(sorted(r))].append(r)
        ok = len(groups) >= 2 and all(len(g) >= min_rows for g in groups.values()) and all(scalar(x) for r in rows for x in r.values())
        if buckets and ok:
            return "\n\n".join(to_toon(g) for g in groups.values()), "buckets"
    if nested:
        changed = False

        def walk(x):
            nonlocal changed
            if records(x) and len(x) >= min_rows and len({tuple(sorted(r)) for r in x}) == 1 and all(scalar(y) for r in x for y in r.values()):
                changed = True
                return to_toon(x)
            if isinstance(x, dict):
                return {k: walk(y) for k, y in x.items()}
            return [walk(y) for y in x] if isinstance(x, list) else x

        out = walk(v)
        if changed:
            return dumps(out), "nested"
    return None


def leaf_text(v) -> str:
    if isinstance(v, dict):
        return " ".join(map(leaf_text, v.values()))
    if isinstance(v, list):
        return " ".join(map(leaf_text, v))
    return "" if v is None else v if isinstance(v, str) else dumps(v)


def outliers(rows: list[dict], texts: list[str]) -> list[int]:
    """Rows that report an error, or hold a rare value of a field with few values."""
    n = len(rows)
    rare, few = max(1, n // 20), min(max(n // 10, 2), 24)
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in rows:
        for k, v in r.items():
            if scalar(v):
                counts[k][dumps(v)] += 1
    odd = lambda r: any(scalar(v) and 2 <= len(counts[k]) <= few and counts[k][dumps(v)] <= rare for k, v in r.items())
    return [i for i in range(n) if _ERROR.search(texts[i]) or odd(rows[i])]


def crush(v, most: int = 50, query: set[str] = frozenset()) -> tuple[object, int] | None:
    """A long record array sampled to `most` rows: ends, outliers, then a diverse rest."""
    if isinstance(v, dict):
        out, total = {}, 0
        sampled = []
        for k, x in v.items():
            c = crush(x, most, query) if isinstance(x, list) else None
            out[k] = c[0] if c else x
            if c:
                sampled.append((k, c[1]))
                total += c[1]
        for k, n in sampled:
            out[f"_sampled_from_{k}"] = Number(n)
        return (out, total) if sampled else None
    if not records(v) or len(v) <= most:
        return None
    n, texts = len(v), [dumps(r) for r in v]
    first = min(max(round(most * 0.6), 1), n)
    last = min(max(round(most * 0.2), 1), max(n - first, 1))
    keep = set(range(first)) | set(range(n - last, n))
    for i in outliers(v, texts):
        if len(keep) >= most:
            break
        keep.add(i)
    rest = [i for i in range(n) if i not in keep]
    if len(keep) < most and rest:
        rel = [len(query.intersection(words(texts[i]))) / max(1, len(query)) for i in rest]
        picked = celf([pairs(leaf_text(v[i])) for i in rest], [1] * len(rest), rel, most - len(keep))
        keep.update(rest[i] for i in picked)
    return [v[i] for i in sorted(keep)], n


def minify_schema(s, most: int = 300):
    """A JSON schema without what models don't need; property names stay as they are."""
    if not isinstance(s, dict):
        return [minify_schema(x, most) for x in s] if isinstance(s, list) else s
    out = {}
    for k, v in s.items():
        if k in ("$schema", "title", "examples", "$comment") and not isinstance(v, dict) or (k == "description" and v == ""):
            continue
        if k == "type" and isinstance(v, list) and len(v) == 1:
            out[k] = v[0]
        elif k == "description" and isinstance(v, str):
            out[k] = trim_description(v, most)
        elif k in ("properties", "$defs", "definitions", "patternProperties") and isinstance(v, dict):
            seen: set[str] = set()
            out[k] = {}
            for name, sub in v.items():
                sub = minify_schema(sub, most)
                d = sub.get("description") if isinstance(sub, dict) else None
                if d in seen:
                    del sub["description"]
                elif d:
                    seen.add(d)
                out[k][name] = sub
        else:
            out[k] = minify_schema(v, most) if isinstance(v, (dict, list)) and k not in ("enum", "const", "default") else v
    return out


def trim_description(text: str, most: int = 300) -> str:
    """The first sentence, then those densest in identifiers while they fit, in order."""
    if len(text) <= most:
        return text
    parts = re.findall(r"[^.!?\n]+(?:[.!?]+(?:\s|$)|\n|$)", text) or [text]
    dense = lambda p: len(re.findall(r"\w*[_`./()<>]\w*|\b[a-z]+[A-Z]\w*|\b\d+\b", p)) / max(1, len(p))
    kept, size = {0}, len(parts[0])
    for i in sorted(range(1, len(parts)), key=lambda i: (-dense(parts[i]), i)):
        if size + len(parts[i]) <= most:
            kept.add(i)
            size += len(parts[i])
    out = "".join(p for i, p in enumerate(parts) if i in kept).strip()
    return out if len(out) <= most else out[: most - 1].rstrip() + "…"


def hygiene(text: str, strip_base64: bool = False, unicode_form: bool = False, digits: int | None = None) -> str:
    v = parsed(text)
    if v is not None and digits:
        text = dumps(round_numbers(v, digits))
    else:
        text = minify(text)
    if strip_base64:
        text = scrub_base64(text)
    return normal_unicode(text) if unicode_form else text


def is_structured(text: str) -> bool:
    """JSON, records, delimited or key-value lines, or text dense in signs."""
    if parsed(text) is not None or "},{" in text:
        return True
    ls = [x for x in lines(text) if x.strip()]
    if len(ls) >= 3:
        for d in ",\t|;":
            n = [x.count(d) for x in ls]
            if max(n) and 4 * n.count(max(n)) >= 3 * len(ls):
                return True
        if 4 * sum(bool(re.match(r"\s*[\w.\-]+\s*[:=]\s*\S", x)) for x in ls) >= 3 * len(ls):
            return True
    solid = "".join(text.split())
    return len(solid) >= 40 and 100 * (len(solid) - sum(map(str.isalnum, solid))) >= 22 * len(solid)

"""Source code in texts: function skeletons and whitespace."""

from __future__ import annotations

import ast
import re

from tokenweir.functions.lex import words

BRACE = {"rust", "rs", "go", "java", "javascript", "js", "typescript", "ts", "tsx", "jsx", "c", "cpp", "c++", "csharp", "cs", "php", "kotlin", "swift", "scala"}
PYTHON = {"python", "py"}
FENCE = re.compile(r"```([\w+#-]*)\n(.*?)```", re.S)
_HEAD = re.compile(r"(?m)^[ \t]*(?:[\w<>\[\]&*:,~ \t]+[ \t&*])?(?:fn|func|function|def)?[ \t]*([A-Za-z_]\w*)[ \t]*(?:<[^<>{}\n]*>)?\([^{};]*\)[^{};\n]*\{")
_CONTROL = {"if", "for", "while", "switch", "catch", "match", "return", "else", "do", "with"}


def subtokens(name: str) -> list[str]:
    cut = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    cut = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", cut)
    return [w for w in re.split(r"[^a-z0-9]+", cut.lower()) if w]


def close_brace(code: str, at: int) -> int:
    """The place after the brace that closes the one at `at`; quotes and comments don't count."""
    depth, i, n = 0, at, len(code)
    while i < n:
        c = code[i]
        if c in "\"'`":
            j = i + 1
            while j < n and code[j] != c and (code[j] != "\n" or c == "`"):
                j += 2 if code[j] == "\\" else 1
            i = j if j < n and code[j] == c else i
        elif code.startswith("//", i):
            i = code.find("\n", i)
            if i < 0:
                return n
        elif code.startswith("/*", i):
            i = code.find("*/", i) + 1
            if i <= 0:
                return n
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return n


def functions(code: str, lang: str) -> list[tuple[str, int, int, str]]:
    """(name, body start, body end, stub) of outermost functions."""
    if lang in PYTHON:
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError):
            return []
        at = [0]
        for line in code.split("\n"):
            at.append(at[-1] + len(line) + 1)
        out = []
        scopes = [tree, *(n for n in ast.walk(tree) if isinstance(n, ast.ClassDef))]
        for node in (n for s in scopes for n in s.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))):
            first = node.body[0]
            if first.lineno > node.lineno:
                out.append((node.name, at[first.lineno - 1], min(at[node.end_lineno], len(code)), " " * first.col_offset + "...\n"))
        return sorted(out, key=lambda f: f[1])
    out, at = [], 0
    while m := _HEAD.search(code, at):
        if m[1] in _CONTROL:
            at = m.end()
            continue
        end = close_brace(code, m.end() - 1)
        out.append((m[1], m.end(), end - 1, " /* … */ "))
        at = end
    return out


def skeleton(code: str, lang: str, query: set[str], full: int = 5, drop: bool = False, drop_lines: int = 8) -> str:
    """The functions nearest to the query whole, the others by signature, long unrelated ones dropped on request."""
    fns = functions(code, lang.lower())
    hits = [len(query.intersection(subtokens(name) + words(code[a:b]))) for name, a, b, _ in fns]
    whole = set(sorted(range(len(fns)), key=lambda i: (-hits[i], i))[:full])
    out, at = [], 0
    for i, (name, a, b, stub) in enumerate(fns):
        if i in whole or len(stub) >= b - a:
            continue
        gone = drop and not hits[i] and code[a:b].count("\n") >= drop_lines
        out += [code[at:a], (stub if not gone else stub.replace("…", "dropped"))]
        at = b
    return "".join(out) + code[at:]


def minify(code: str, lang: str) -> str:
    """Brace languages without indentation and blank lines; lines inside of quotes stay."""
    if lang.lower() not in BRACE:
        return code
    parts = re.split(r"(\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`)", code)
    return "".join(p if i % 2 else re.sub(r"\n[ \t]*(?=\n|[^\s])", "\n", re.sub(r"\n\s*\n+", "\n", p)) for i, p in enumerate(parts))


def in_fences(text: str, change) -> str:
    return FENCE.sub(lambda m: f"```{m[1]}\n{change(m[2], m[1])}```", text)

"""Who sent a request, from its system text: agent, working directory and a stable session name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tokenweir.functions.text import let

# Agents and the texts that their system prompts hold, in order of precedence.
AGENTS = [
    ("claude-code", ["Claude Code"]),
    ("codex", ["running as a coding agent in the Codex CLI", "Codex CLI", "You are Codex"]),
    ("cursor", ["You operate exclusively in Cursor"]),
    ("cline", ["You are Cline,"]),
    ("roo", ["You are Roo,"]),
    ("kilo", ["You are Kilo Code,"]),
    ("goose", ["agent called goose"]),
    ("opencode", ["You are OpenCode,", "You are opencode,"]),
    ("crush", ["You are Crush,"]),
    ("qwen", ["You are Qwen Code,"]),
    ("grok", ["You are Grok CLI"]),
    ("kimi", ["You are Kimi Code CLI,"]),
    ("mistral-vibe", ["operating as and within Mistral Vibe"]),
    ("mux", ["agent called Mux"]),
    ("pi", ["Oh My Pi"]),
    ("forge", ["You are Forge,"]),
    ("openclaw", ["OpenClaw"]),
    ("gemini", ["You are Gemini CLI,", "interactive CLI agent specializing in software engineering tasks"]),
]
# How a line begins that names the working directory.
DIRECTORY = ["Current working directory:", "cwd:", "Working directory:"]
# Offset basis and multiplier of the 64-bit FNV-1a hash, as 32-bit halves and small factors.
BASIS = (0xCBF29CE4, 0x84222325)
FACTOR = 0x1B3
LOW = (1 << 32) - 1


def agent(system: Column, agents=AGENTS) -> Column:
    """The first agent of the list whose text stands in the system text; null if none does."""
    out = F.lit(None).cast("string")
    for label, marks in reversed(agents):
        any_of = F.contains(system, F.lit(marks[0]))
        for m in marks[1:]:
            any_of = any_of | F.contains(system, F.lit(m))
        out = F.when(any_of, F.lit(label)).otherwise(out)
    return out


def directory(system: Column) -> Column:
    """What the first line that names a working directory says, without quotes; null if none does."""
    named = rf"^\s*(?:{'|'.join(DIRECTORY)})\s*[`\"]*(.*?)[`\"]*\s*$"
    said = F.transform(F.split(system, r"\r?\n"), lambda x: F.regexp_extract(x, named, 1))
    return F.get(F.filter(said, lambda x: F.trim(x) != ""), F.lit(0))


def fnv1a_hex(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, as 16 hex digits; in 32-bit halves, as nothing may overflow."""

    def byte(i: Column, digits: Column) -> Column:
        return F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")

    def step(h: Column, b: Column) -> Column:
        low = h["lo"].bitwiseXOR(b)
        product = low * FACTOR
        high = (h["hi"] * FACTOR + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(LOW))
        return F.struct(high.alias("hi"), product.bitwiseAND(F.lit(LOW)).alias("lo"))

    def hashed(digits: Column) -> Column:
        n = (F.length(digits) / 2).cast("int")
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.lit(BASIS[0]).cast("long").alias("hi"), F.lit(BASIS[1]).cast("long").alias("lo"))
        return F.aggregate(F.transform(places, lambda i: byte(i, digits)), start, step)

    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    h = let(F.hex(F.encode(text, "UTF-8")), hashed)
    return F.when(text.isNotNull(), let(h, lambda x: F.concat(half(x["hi"]), half(x["lo"]))))

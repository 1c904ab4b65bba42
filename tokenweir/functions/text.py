"""Row-level text predicates and transforms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severity patterns of a line.
STRONG = r"(?i)\b(error|fatal|fail(?:ed|ure)?|panic(?:ked)?|exception|traceback|segfault|assert(?:ion)?|not ok)\b|failure"
WARN = r"(?i)\b(warn(?:ing)?|deprecat)"
LEVEL = r"(?i)\b(error|warn|info|debug|trace|fatal|fail|panic|exception)\b"
# A search hit: path, line number, text.
GREP_LINE = r"^(?:[A-Za-z]:)?[^:\n]*[A-Za-z./\\][^:\n]*:\d+:"
# Lines that only lock files have, wherever they stand in a text.
LOCK_HEADER = (
    r"(?im)^[ \t]*(?:# This file is automatically @?generated|#[^\n]*\bgenerated by (?:cargo|poetry)|# yarn lockfile"
    r'|lockfileVersion:|(?:\{[^\n]*)?"lockfileVersion"[ \t]*:)'
)
# The record lines of lock files.
LOCK_RECORD = r'^\s*(?:"?(?:resolved|integrity|checksum|version)"?\s*[:= ]|\[\[package\]\])'
# The variable parts of a line, most specific first.
VARIABLE = (
    r'"[^"]*"'
    r"|\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
    r"|\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
    r"|\b0x[0-9a-fA-F]+\b"
    r"|\b[0-9a-fA-F]{12,}\b"
    r"|\b\d{1,3}(?:\.\d{1,3}){3}\b"
    r"|\d+(?:\.\d+)?"
)
# White space as the SQL's patterns have it; Java's \s has the vertical tab too.
BLANK = r"\t\n\f\r "
# A parser that bounds neither depth nor length and takes no signs beyond JSON's.
_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"} | dict.fromkeys(("maxNestingDepth", "maxNumLen", "maxStringLen"), str(2**31 - 1))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row: a lambda's argument is never written out again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Lines without their ends; a final line break opens no line."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\r?\n"))


def nonblank(ls: Column) -> Column:
    return F.filter(ls, lambda x: F.trim(x) != "")


def count_like(ls: Column, pattern: str) -> Column:
    return F.size(F.filter(ls, lambda x: F.rlike(x, F.lit(pattern))))


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def output_kind(text: Column) -> Column:
    """diff, grep, log or null, in that order of precedence."""
    t, ls = F.ltrim(text), nonblank(lines(text))
    n = F.size(ls)
    diff = t.startswith("diff --git ") | (
        (t.startswith("@@ ") | F.contains(t, F.lit("\n@@ ")))
        & (t.startswith("--- ") | F.contains(t, F.lit("\n--- ")) | F.contains(t, F.lit("\n+++ ")))
    )
    grep = count_like(ls, GREP_LINE)
    strong = count_like(ls, STRONG)
    log = (n >= 8) & ((count_like(ls, LEVEL) * 100 >= n * 30) | ((strong >= 2) & (strong * 10 >= n)))
    return F.when(diff, "diff").when((n >= 3) & (grep >= 3) & (grep * 4 >= n * 3), "grep").when(log, "log")


def priority(line: Column) -> Column:
    return (
        F.when(F.rlike(line, F.lit(STRONG)), 1.0)
        .when(F.rlike(line, F.lit(WARN)), 0.6)
        .when(line.startswith(" ") | line.startswith("\t"), 0.5)
        .otherwise(0.3)
    )


def query_bonus(line: Column, query: Column) -> Column:
    hits = F.size(F.array_intersect(words(line), query))
    return F.least(F.lit(0.6), hits * 0.2)


def template(line: Column) -> Column:
    """The line with variables as `{}` and runs of blanks as one."""
    return F.regexp_replace(F.regexp_replace(line, VARIABLE, "{}"), r"\s+", " ")


def variables(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(VARIABLE), F.lit(0))


def occurrences(sign: str):
    """How often a sign stands in a line, as a lambda of one argument: Spark would fill a second one, defaults too, with the line's index."""
    return lambda x: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))


def json_valid(text: Column) -> Column:
    """One whole array or object, as the SQL's `json_valid` reads it: JSON, but a comma may stand before a closing bracket and NaN and infinity are numbers."""
    plain = F.regexp_replace(text, r'\\(?:["\\/bfnrt]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})', "x")
    plain = F.regexp_replace(plain, r'"[^"\\\x00-\x1f]*+"', '""')
    plain = F.regexp_replace(plain, r"(?<![\w.+-])-?(?i:nan|inf(?:inity)?)(?![\w.+-])", "0")
    plain = F.regexp_replace(plain, r"([^\[{,: \t\r\n])[ \t\r\n]*+,(?=[ \t\r\n]*+[\]}])", "$1")
    # The parser stops behind a value; what could follow inside an object can't follow inside an array.
    inside = [F.from_json(F.concat(F.lit(a), plain, F.lit(b)), "z int", _JSON)["z"].isNotNull() for a, b in (('{"a":', ',"z":1}'), ('{"a":[', '],"z":1}'))]
    return ~F.contains(plain, F.lit("\\")) & inside[0] & inside[1]


def structured(text: Column) -> Column:
    """JSON, records, delimited or key-value lines, or text dense in signs."""

    def uniform(counts: Column, n: Column) -> Column:
        return let(F.array_max(counts), lambda most: (most > 0) & (F.size(F.filter(counts, lambda c: c == most)) * 4 >= n * 3))

    def tabular(ls: Column) -> Column:
        n = F.size(ls)
        out = count_like(ls, rf"^[{BLANK}]*[\w.\-]+[{BLANK}]*[:=][{BLANK}]*[^{BLANK}]") * 4 >= n * 3
        for d in [",", "\t", "|", ";"]:
            out = out | let(F.transform(ls, occurrences(d)), lambda c: uniform(c, n))
        return (n >= 3) & out

    t = F.trim(text)
    solid = F.length(F.regexp_replace(t, rf"[{BLANK}]", ""))
    signs = F.regexp_count(t, F.lit(rf"[^\p{{L}}\p{{N}}{BLANK}]"))
    is_json = (F.rlike(t, F.lit(r"^[\[{]")) & json_valid(t)) | F.contains(t, F.lit("},{"))
    return F.coalesce(is_json, F.lit(False)) | let(nonblank(lines(text)), tabular) | ((solid >= 40) & (signs * 100 >= solid * 22))


def generated_kind(text: Column) -> Column:
    """lockfile, minified, base64 or null; texts below 800 characters are none."""
    ls = nonblank(lines(text))
    n = F.size(ls)
    header = F.rlike(text, F.lit(LOCK_HEADER))
    records = count_like(ls, LOCK_RECORD)
    long = F.filter(ls, lambda x: F.length(x) >= 2000)
    packed = F.exists(
        long,
        lambda x: (F.regexp_count(x, F.lit(r"\s")) * 100 < F.length(x) * 8) & (F.regexp_count(x, F.lit(r"[{}();,=]")) * 100 >= F.length(x) * 4),
    )
    blob = F.rlike(text, F.lit(r"[A-Za-z0-9+/=]{1500,}"))
    lock = header | ((n >= 12) & (records * 100 >= n * 15))
    return F.when(F.length(text) < 800, None).when(lock, "lockfile").when(packed, "minified").when(blob, "base64")


def terminal_normal(text: Column) -> Column:
    """No colour codes, line feeds only, and of each line what stands after its last return."""
    plain = F.regexp_replace(text, r"\x1B(?:\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-Z\\-_])", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\r+\n", "\n"), r"(?m)^[^\n]*\r", "")


def unicode_normal(text: Column) -> Column:
    """No-break spaces as spaces, invisible signs dropped (compatibility forms need Arrow)."""
    spaces, gone = "     ", "​‌‍﻿"
    return F.translate(text, spaces + gone, " " * len(spaces))


def significant(x: Column, digits: int = 4) -> Column:
    """x rounded to significant digits; whole numbers and 0 as they are."""
    d = F.lit(digits - 1) - F.floor(F.log10(F.abs(x))).cast("int")
    f = F.pow(F.lit(10.0), d)
    return F.when((x == 0) | (x == F.floor(x)), x).otherwise(F.round(x * f) / f)


def mentions(text: Column, name: Column) -> Column:
    """Whether `name`, taken literally, stands in the text with no identifier character beside it."""
    quoted = F.concat(F.lit(r"(?<!\w)\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.rlike(text, quoted)


def standalone(text: Column, name: str) -> Column:
    """A mention of `name` that no identifier character touches."""
    return mentions(text, F.lit(name))


def subtokens(name: Column) -> Column:
    """Parts of snake and camel case identifiers, lower-cased."""
    cut = F.regexp_replace(F.regexp_replace(name, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(cut), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def answer_normal(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks, CJK signs as words."""
    t = F.regexp_replace(F.lower(text), r"([\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}])", " $1 ")
    ws = F.split(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", ""), r"\s+")
    return F.array_join(F.filter(ws, lambda w: ~w.isin("", "a", "an", "the")), " ")


def elision(n: Column) -> Column:
    return F.when(n == 1, F.lit("[… 1 line omitted …]")).otherwise(F.concat(F.lit("[… "), n.cast("string"), F.lit(" lines omitted …]")))

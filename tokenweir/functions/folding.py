"""Folding of repeated and templated lines, and shapers of tool output."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from tokenweir.functions import text as X
from tokenweir.functions.lex import estimate, lines, simhash, words
from tokenweir.functions.selecting import optimal_keep

_STRONG, _WARN, _LEVEL, _GREP, _LOCK, _VAR = (re.compile(p) for p in (X.STRONG, X.WARN, X.LEVEL, X.GREP_LINE, X.LOCK_HEADER, X.VARIABLE))
_TAG = re.compile(r"^\s*<(/?)([A-Za-z][\w.-]*)(?:\s[^<>]*)?(?<!/)>\s*$")
HEAD = TAIL = 3
MAX_LINES, MIN_LINES = 40, 20


def _blocks(ls: list[str]) -> list[str | None]:
    """For lines that are one XML tag: the text of their block, or a mark of their own if unpaired."""
    out: list[str | None] = [None] * len(ls)
    opened: list[tuple[str, int]] = []
    for i, line in enumerate(ls):
        m = _TAG.match(line)
        if not m:
            continue
        out[i] = f"\0{i}"
        if not m[1]:
            opened.append((m[2], i))
        elif opened and opened[-1][0] == m[2]:
            first = opened.pop()[1]
            out[first] = out[i] = "\n".join(ls[first : i + 1])
    return out


class Alike:
    """Fingerprints by bands: of two that differ in `distance` bits at most, one of distance + 1 or more bands is equal."""

    def __init__(self, distance: int):
        self.distance, self.width = distance, 64 // (distance + 1)
        self.held: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _bands(self, h: int):
        if not self.width:
            return ((0, 0),)
        return ((k, h >> k & (1 << self.width) - 1) for k in range(0, 64, self.width))

    def first(self, h: int) -> int | None:
        """The smallest name of a fingerprint near h."""
        near = [name for band in self._bands(h) for p, name in self.held.get(band, ()) if (p ^ h).bit_count() <= self.distance]
        return min(near, default=None)

    def add(self, h: int, name: int) -> None:
        for band in self._bands(h):
            self.held.setdefault(band, []).append((h, name))


def dedup(text: str, near: bool = False, distance: int = 3) -> str:
    """Repeated lines once, at their first place, with their number; blanks stay."""
    ls = lines(text)
    group: dict[tuple, int] = {}
    alike = Alike(distance)
    where, count = [-1] * len(ls), []
    for i, (line, block) in enumerate(zip(ls, _blocks(ls))):
        if not line.strip():
            continue
        g = group.get((line, block))
        if g is None:
            h = simhash(line) if near else 0
            g = alike.first(h) if near and block is None else None
        if g is None:
            g = len(count)
            count.append(0)
            if near:
                alike.add(h, g)
        group[line, block] = g
        count[g] += 1
        where[i] = g
    if not count or max(count) < 2:
        return text
    out, seen = [], set()
    for line, g in zip(ls, where):
        if g < 0:
            out.append(line)
        elif g not in seen:
            seen.add(g)
            out.append(f"{line} [×{count[g]}]" if count[g] > 1 else line)
    return "\n".join(out)


def dedup_adjacent(text: str) -> str:
    out: list[list] = []
    for line in lines(text):
        if out and out[-1][0] == line and line.strip():
            out[-1][1] += 1
        else:
            out.append([line, 1])
    if all(n == 1 for _, n in out):
        return text
    return "\n".join(f"{x} [×{n}]" if n > 1 else x for x, n in out)


def template(line: str) -> tuple[str, list[str]]:
    return re.sub(r"\s+", " ", _VAR.sub("{}", line)), _VAR.findall(line)


def _fold_numbers(vals: list[str]) -> str | None:
    if any(not v.isascii() or not v.isdigit() or str(int(v)) != v for v in vals):
        return None
    n = list(map(int, vals))
    step = n[1] - n[0]
    if step == 0 or any(b - a != step for a, b in zip(n, n[1:])):
        return None
    return f"{vals[0]}..{vals[-1]}" + ("" if step == 1 else f" step {step}")


def _fold_times(vals: list[str]) -> str | None:
    kinds = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%SZ")
    for kind in kinds:
        try:
            t = [datetime.strptime(v, kind) for v in vals]
        except ValueError:
            continue
        step = t[1] - t[0]
        if step == timedelta(0) or any(b - a != step for a, b in zip(t, t[1:])) or [x.strftime(kind) for x in t] != vals:
            return None
        return f"{vals[0]}..{vals[-1]} step {int(step.total_seconds())}s"
    return None


def render_rows(rows: list[list[str]]) -> str:
    """Value tuples row by row, or column by column with ranges where that is shorter."""
    flat = " ".join(f"({','.join(r)})" for r in rows)
    width = len(rows[0])
    clear = all(len(r) == width and not any("," in v or ";" in v or ".." in v for v in r) for r in rows)
    if not width or not clear or len(rows) < 2:
        return flat
    cols, folded = [], False
    for c in range(width):
        vals = [r[c] for r in rows]
        short = vals[0] if len(set(vals)) == 1 else _fold_numbers(vals) or _fold_times(vals)
        folded |= short is not None
        cols.append(short if short is not None else ",".join(vals))
    columns = f"({'; '.join(cols)})"
    return columns if folded and len(columns.encode()) < len(flat.encode()) else flat


def fold_runs(text: str, least: int = 3) -> tuple[str, bool]:
    """Runs of neighbouring lines with one template, where folding makes them shorter."""
    ls = lines(text)
    out, folded, i = [], False, 0
    tpls = [template(x) for x in ls]
    while i < len(ls):
        j = i + 1
        while j < len(ls) and tpls[j][0] == tpls[i][0]:
            j += 1
        short = f"{tpls[i][0]} [×{j - i}: {render_rows([v for _, v in tpls[i:j]])}]"
        if j - i >= least and "{}" in tpls[i][0] and len(short.encode()) < sum(len(x.encode()) + 1 for x in ls[i:j]):
            out.append(short)
            folded = True
        else:
            out += ls[i:j]
        i = j
    return ("\n".join(out), True) if folded else (text, False)


def _merged(keyed: dict[tuple, list[int]], masks: list[set[str]], share: float) -> list[list[int]]:
    """The buckets' members, each bucket joined to the first kept mask of its word count that agrees to `share`.

    Two sets of that Jaccard share a word among the rarest |x| - ceil(share |x|) + 1 of each
    (prefix filter), so only kept masks under such a word are compared.
    """
    seen = Counter((n, w) for (n, _), mask in zip(keyed, masks) for w in mask)
    kept: list[tuple[set[str], list[int]]] = []
    under: dict[tuple, list[int]] = defaultdict(list)
    for ((n, _), members), mask in zip(keyed.items(), masks):
        rarest = sorted(mask, key=lambda w: (seen[n, w], w))
        prefix = [(n, w) for w in rarest[: len(mask) - math.ceil(share * len(mask)) + 1]]
        near = sorted({k for w in prefix for k in under[w]})
        at = next((k for k in near if len(kept[k][0] & mask) >= share * len(kept[k][0] | mask)), None)
        if at is None:
            for w in prefix:
                under[w].append(len(kept))
            kept.append((mask, list(members)))
        else:
            kept[at][1].extend(members)
    return [sorted(members) for _, members in kept]


def fold_global(text: str, share: float = 0.9, vote: int = 10, least: int = 3) -> tuple[str, bool]:
    """Lines of one shape wherever they stand, folded at their first place.

    Lines fall into buckets by number of words and five anchor characters; buckets with
    one word count whose constant words agree to `share` (Jaccard) are merged, however many
    there are; the members' first `vote` lines decide which words are constant.
    """
    ls = lines(text)
    keyed: dict[tuple, list[int]] = defaultdict(list)
    for i, line in enumerate(ls):
        if line.strip():
            n = len(line) - 1
            keyed[len(line.split()), tuple(line[k] if not line[k].isdigit() else "0" for k in (0, n // 4, n // 2, 3 * n // 4, n))].append(i)
    sets = _merged(keyed, [set(template(ls[members[0]])[0].split()) for members in keyed.values()], share)
    gone, put = set(), {}
    for members in sets:
        if len(members) < least:
            continue
        rows = [ls[i].split() for i in members]
        const = []
        for column in zip(*rows[:vote]):
            top = Counter(column).most_common(2)
            alone = len(top) == 1 or top[0][1] > top[1][1]
            const.append(top[0][0] if alone and top[0][1] >= max(1, -(-len(column) // 2)) else None)
        fits = [i for i, r in zip(members, rows) if all(c is None or c == w for c, w in zip(const, r))]
        values = [[w for c, w in zip(const, ls[i].split()) if c is None] for i in fits]
        if len(fits) < least or None not in const:
            continue
        slots = list(zip(*values))
        if not all(sum(any(ch.isdigit() for ch in v) or bool(_VAR.fullmatch(v)) for v in s) * 2 >= len(s) for s in slots):
            continue
        short = f"{' '.join('{}' if c is None else c for c in const)} [×{len(fits)}: {render_rows(values)}]"
        if len(short.encode()) < sum(len(ls[i].encode()) + 1 for i in fits):
            put[fits[0]] = short
            gone.update(fits[1:])
    if not put:
        return fold_runs(text, least)
    return "\n".join(put.get(i, x) for i, x in enumerate(ls) if i not in gone), True


def priority(line: str) -> float:
    return 1.0 if _STRONG.search(line) else 0.6 if _WARN.search(line) else 0.5 if line[:1] in " \t" and line else 0.3


def bonus(line: str, query: set[str]) -> float:
    return min(0.6, 0.2 * len(query.intersection(words(line)))) if query else 0.0


def elide(ls: list[str], keep: list[bool]) -> str:
    """Kept lines, and a mark for each dropped run that is longer than its mark; a head line says how many are shown."""
    out: list[str] = []
    i = marks = shown = 0
    while i < len(ls):
        j = i
        while j < len(ls) and keep[j] == keep[i]:
            j += 1
        n = j - i
        mark = "[… 1 line omitted …]" if n == 1 else f"[… {n} lines omitted …]"
        if not keep[i] and len(mark.encode()) + 1 < sum(len(x.encode()) + 1 for x in ls[i:j]):
            out.append(mark)
            marks += 1
        else:
            out += ls[i:j]
            shown += n
        i = j
    head = [f"[showing {shown} of {len(ls)} lines; run the tool again for all of them]"] if marks else []
    return "\n".join(head + out)


def select_lines(scores: list[float], k: int, force: float = 1.0) -> list[bool]:
    n = len(scores)
    keep = [i < HEAD or i >= n - TAIL or s >= force for i, s in enumerate(scores)]
    room = k - sum(keep)
    for i in sorted(range(n), key=lambda i: (-scores[i], i)):
        if room <= 0:
            break
        if not keep[i]:
            keep[i] = True
            room -= 1
    return keep


def kind(text: str) -> str | None:
    t = text.lstrip()
    hunk, head = t.startswith("@@ ") or "\n@@ " in t, t.startswith("--- ") or "\n--- " in t or "\n+++ " in t
    if t.startswith("diff --git ") or (hunk and head):
        return "diff"
    ls = [x for x in lines(text) if x.strip()]
    hits = sum(bool(_GREP.match(x)) for x in ls)
    if len(ls) >= 3 and hits >= 3 and hits * 4 >= len(ls) * 3:
        return "grep"
    if len(ls) >= 8:
        level, strong = (sum(bool(p.search(x)) for x in ls) for p in (_LEVEL, _STRONG))
        if level * 100 >= len(ls) * 30 or (strong >= 2 and strong * 10 >= len(ls)):
            return "log"
    return None


def shape_log(text: str, query: set[str], max_lines: int = MAX_LINES) -> str | None:
    ls = lines(text)
    p = [priority(x) for x in ls]
    errors = sum(v >= 1.0 for v in p)
    if errors and len(ls) >= 60 and errors * 4 <= len(ls):
        keep: list[bool] = []
        for line, v in zip(ls, p):
            keep.append(v >= 1.0 or (line[:1] in (" ", "\t") and bool(keep) and keep[-1]))
        if all(keep):
            return None
        warned = sum(0.6 <= v < 1.0 for v in p)
        return f"[log: {len(ls)} lines, {errors} errors, {warned} warnings; errors only]\n" + elide(ls, keep)
    folded, any_fold = fold_global(text)
    ls = lines(folded)
    if len(ls) > max_lines:
        scores = [priority(x) + bonus(x, query) for x in ls]
        keep = select_lines(scores, optimal_keep(ls, 5, max_lines))
        if not all(keep):
            return elide(ls, keep)
    return folded if any_fold else None


def shape_grep(text: str, query: set[str], max_lines: int = MAX_LINES) -> str | None:
    folded, any_fold = fold_runs(text)
    ls = lines(folded)
    if len(ls) <= max_lines:
        return folded if any_fold else None
    seen: set[str] = set()
    scores = []
    for x in ls:
        m = re.match(r"((?:[A-Za-z]:)?[^:\n]*):\d+:", x)
        first = bool(m) and m[1] not in seen
        seen.update([m[1]] if m else [])
        scores.append(priority(x) + bonus(x, query) + (0.5 if first else 0))
    return elide(ls, select_lines(scores, optimal_keep(ls, 5, max_lines), 1.5))


def shape_diff(text: str, query: set[str], max_files: int = 20, max_hunks: int = 10, context: int = 3) -> str | None:
    """At most max_files files and max_hunks hunks per file (first and last always), less context around changes."""
    files: list[list] = []
    for line in lines(text):
        if line.startswith("diff --git ") or (line.startswith("--- ") and (not files or files[-1][1])):
            files.append([[line], []])
        elif line.startswith("@@ ") and files:
            files[-1][1].append([line])
        elif files and files[-1][1]:
            files[-1][1][-1].append(line)
        elif files:
            files[-1][0].append(line)
        else:
            files.append([[line], []])

    def best(items: list, score, cap: int) -> list[bool]:
        if len(items) <= cap:
            return [True] * len(items)
        keep = [i in (0, len(items) - 1) for i in range(len(items))]
        for i in sorted(range(len(items)), key=lambda i: (-score(items[i]), i)):
            if sum(keep) >= cap:
                break
            keep[i] = True
        return keep

    changed = lambda h: sum(x[:1] in ("+", "-") for x in h)
    hunk_score = lambda h: min(0.5, 0.05 * changed(h)) + max([bonus(x, query) for x in h] or [0])
    out = []
    for keep_file, (head, hunks) in zip(best(files, lambda f: sum(map(changed, f[1])), max_files), files):
        if not keep_file:
            out.append(f"[… file omitted: {head[0]} …]")
            continue
        out += head
        for keep_hunk, hunk in zip(best(hunks, hunk_score, max_hunks), hunks):
            if not keep_hunk:
                out.append(f"[… {len(hunk)} lines of a hunk omitted …]")
                continue
            near = [any(y[:1] in ("+", "-") for y in hunk[max(1, i - context) : i + context + 1]) for i in range(len(hunk))]
            out += [x for i, x in enumerate(hunk) if i == 0 or near[i]]
    short = "\n".join(out)
    return short if len(short) < len(text.rstrip("\n")) else None


def shape_generated(text: str) -> str | None:
    if len(text) < 800:
        return None
    ls = [x for x in lines(text) if x.strip()]
    records = sum(bool(re.match(X.LOCK_RECORD, x)) for x in ls)
    if _LOCK.search(text) or (len(ls) >= 12 and records * 100 >= 15 * len(ls)):
        what = "lockfile"
    elif any(len(x) >= 2000 and sum(map(str.isspace, x)) * 100 < 8 * len(x) and sum(c in "{}();,=" for c in x) * 100 >= 4 * len(x) for x in ls):
        what = "minified code"
    elif re.search(r"[A-Za-z0-9+/=]{1500,}", text):
        what = "base64 data"
    else:
        return None
    return f"[… {what} omitted: {len(ls)} lines, {len(text)} characters …]"


def shape(text: str, query: set[str] = frozenset(), min_lines: int = MIN_LINES, max_lines: int = MAX_LINES) -> str | None:
    """A tool output in its shorter form, or None if there is none."""
    plain = re.sub(r"\x1B(?:\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-Z\\-_])", "", text)
    plain = re.sub(r"(?m)^[^\n]*\r", "", re.sub(r"\r+\n", "\n", plain))
    n = len(lines(plain))
    if n < min_lines:
        return None
    what = kind(plain)
    if what == "log":
        return shape_log(plain, query, max_lines)
    if what == "grep":
        return shape_grep(plain, query, max_lines)
    if what == "diff":
        return shape_diff(plain, query)
    out = shape_generated(plain)
    if out is None and n >= 30:
        folded, any_fold = fold_global(plain)
        if any_fold:
            ls = lines(folded)
            keep = select_lines([priority(x) + bonus(x, query) for x in ls], optimal_keep(ls, 5, max_lines)) if len(ls) > max_lines else [True] * len(ls)
            out = folded if all(keep) else elide(ls, keep)
    return out


def cheaper(old: str, new: str | None) -> str:
    return new if new is not None and estimate(new) < estimate(old) else old

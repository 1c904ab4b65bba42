"""Phrase abbreviation: repeated word spans of a request's prose behind short marks.

Repeats come from a suffix array over word numbers (prefix doubling) and the common
prefixes of neighbouring suffixes. Phrases are committed greedily by what they save in
estimated tokens, counted anew after each commit.
"""

from __future__ import annotations

import heapq
import re

import numpy as np

from tokenweir.functions.lex import estimate

MARKS = ("§", "¤", "¦", "¬")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a number sequence, by doubling the sorted length."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: max(0, n - k)] = rank[k:]
        order = np.lexsort((nxt, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (nxt[order[1:]] != nxt[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if k >= n or rank.max(initial=0) == n - 1:
            return order
        k *= 2


def neighbour_lcp(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    out = np.zeros(len(order), np.int64)
    for step in range(most):
        a, b = order[1:] + step, order[:-1] + step
        ok = (out[1:] == step) & (a < len(s)) & (b < len(s))
        same = np.zeros(len(a), bool)
        same[ok] = s[a[ok]] == s[b[ok]]
        out[1:][same] += 1
    return out


def mine(texts: list[str], entries: int = 32, longest: int = 32) -> tuple[list[str], list[tuple[str, str]]]:
    """(new texts, [(mark, phrase)]); nothing changes unless a phrase saves tokens."""
    mark = next((m for m in MARKS if not any(m in t for t in texts)), None)
    split = [re.findall(r"\S+", t) for t in texts]
    if mark is None or sum(map(len, split)) < 4:
        return texts, []
    ids: dict[str, int] = {}
    seq: list[int] = []
    for k, ws in enumerate(split):
        seq += [ids.setdefault(w, len(ids)) for w in ws] + [-1 - k]  # texts end in a number of their own
    s = np.array(seq)
    order = suffix_array(s)
    lcp = neighbour_lcp(s, order, longest)
    names = list(ids)
    often: dict[tuple, int] = {}  # neighbours that share a span: its occurrences less one
    for i in np.flatnonzero(lcp >= 2).tolist():
        for n in range(2, int(lcp[i]) + 1):
            p = tuple(seq[order[i] : order[i] + n])
            often[p] = often.get(p, 1) + 1
    gain = lambda p, live, tag: live * (estimate(p) - estimate(tag)) - estimate(f"{tag}={p}\n")
    heap = []
    for span, n in often.items():
        p = " ".join(names[k] for k in span)
        heap.append((-gain(p, n, f"{mark}1"), -len(p), p))
    heapq.heapify(heap)  # by the most that a phrase can save; what it does save is found when it comes up
    glossary: list[tuple[str, str]] = []
    now = list(texts)
    while heap and len(glossary) < entries:
        bound, size, p = heapq.heappop(heap)
        if bound >= 0:
            break
        tag = f"{mark}{len(glossary) + 1}"
        bounded = re.compile(rf"(?<!\w){re.escape(p)}(?!\w)")
        live = sum(len(bounded.findall(t)) for t in now)
        real = gain(p, live, tag) if live >= 2 else 0
        if real <= 0:
            continue
        if heap and -real > heap[0][0]:
            heapq.heappush(heap, (-real, size, p))
            continue
        now = [bounded.sub(tag, t) for t in now]
        glossary.append((tag, p))
    if glossary and sum(map(estimate, now)) + estimate("".join(f"{t}={p}\n" for t, p in glossary)) >= sum(map(estimate, texts)):
        return texts, []
    return now, glossary


def restore(texts: list[str], glossary: list[tuple[str, str]]) -> list[str]:
    """The texts before mining; later marks stand inside no earlier phrase."""
    out = texts
    for tag, phrase in reversed(glossary):
        out = [re.sub(rf"{re.escape(tag)}(?!\d)", lambda _: phrase, t) for t in out]
    return out

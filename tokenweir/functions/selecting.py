"""Selection of lines, sentences and chunks: saturation, coverage, ranking, diversity."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np

from tokenweir.functions.lex import content_words, simhash, words

_FAIL = re.compile(r"(?i)\b(error|fatal|fail(?:ed|ure)?|exception|traceback|panic)\b")


def pairs(text: str) -> list[tuple[str, str]]:
    ws = words(text)
    return list(dict.fromkeys(zip(ws, ws[1:]))) if len(ws) > 1 else [(w, "") for w in ws]


def optimal_keep(items: list[str], least: int, most: int) -> int:
    """How many items to keep: up to the knee of new word pairs, not more than distinct items."""
    n = len(items)
    lo, hi = min(least, n), min(most, n)
    if n <= lo or hi <= lo:
        return n if n <= lo else lo
    seen: set = set()
    curve = []
    for x in items:
        seen.update(pairs(x))
        curve.append(len(seen))
    knee = hi
    if not curve[-1]:
        knee = lo
    elif n >= 3:
        bow = [c / curve[-1] - i / (n - 1) for i, c in enumerate(curve)]
        best = max(range(n), key=lambda i: (bow[i], -i))
        knee = best + 1 if bow[best] > 0.05 else hi
    reps: list[int] = []
    for x in items:
        h = simhash(x)
        if all((h ^ r).bit_count() > 3 for r in reps):
            reps.append(h)
    return min(max(lo, min(knee, hi)), max(len(reps), lo))


def celf(features: list[list], costs: list[int], relevance: list[float], budget: int, weight: float = 0.5, saturation: float = 0.3) -> list[int]:
    """Greedy by gain per cost of weight * relevance + (1 - weight) * saturated coverage.

    Gains only fall as items are taken, so an item whose stale gain is not the largest
    need not be looked at again (lazy evaluation); ties go to the smaller index.
    """
    total = Counter(f for fs in features for f in fs)
    covered: Counter = Counter()

    def gain(i: int) -> float:
        cover = sum(min(covered[f] + 1, saturation * total[f]) - min(covered[f], saturation * total[f]) for f in features[i])
        return (weight * relevance[i] + (1 - weight) * cover) / costs[i]

    heap = [(-gain(i), i, 0) for i in range(len(costs)) if 0 < costs[i] <= budget]
    heapq.heapify(heap)
    taken: list[int] = []
    spent = 0
    while heap:
        g, i, when = heapq.heappop(heap)
        if spent + costs[i] > budget:
            continue
        if when < len(taken):
            heapq.heappush(heap, (-gain(i), i, len(taken)))
            continue
        if g >= 0:
            break
        covered.update(features[i])
        spent += costs[i]
        taken.append(i)
    return sorted(taken)


def bm25(chunks: list[str], query: list[str], k1: float = 1.2, b: float = 0.75, delta: float = 1.0) -> list[float]:
    docs = [Counter(words(c)) for c in chunks]
    size = [sum(d.values()) for d in docs]
    mean = sum(size) / max(1, len(size)) or 1.0
    out = [0.0] * len(chunks)
    for term in dict.fromkeys(query):
        df = sum(term in d for d in docs)
        if not df:
            continue
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for i, d in enumerate(docs):
            if d[term]:
                out[i] += idf * (d[term] * (k1 + 1) / (d[term] + k1 * (1 - b + b * size[i] / mean)) + delta)
    return out


def expanded(chunks: list[str], query: list[str], scores: list[float], feedback: int = 4, n_terms: int = 10, mix: float = 0.5) -> list[float]:
    """Scores mixed with those of expansion terms, where the query is short or its scores flat."""
    order = order_desc(scores)
    top = [scores[i] for i in order[:2]]
    if not scores or not scores[order[0]] or not (len(set(query)) <= 4 or (len(top) == 2 and top[0] < 1.15 * top[1])):
        return scores
    best = [i for i in order[:feedback] if scores[i] > 0]
    total = sum(scores[i] for i in best)
    weight: Counter = Counter()
    for i in best:
        ws = content_words(chunks[i])
        for w, c in Counter(ws).items():
            weight[w] += scores[i] / total * c / len(ws)
    for q in query:
        weight.pop(q, None)
    extra = sorted(weight, key=lambda w: (-weight[w], w))[:n_terms]
    more = bm25(chunks, extra)
    a, z = max(scores) or 1.0, max(more, default=0) or 1.0
    return [(1 - mix) * s / a + mix * m / z for s, m in zip(scores, more)]


def order_desc(scores: list[float]) -> list[int]:
    return sorted(range(len(scores)), key=lambda i: (-scores[i], i))


def textrank(chunks: list[str], damping: float = 0.85, rounds: int = 30, most: int = 2000) -> list[int]:
    """Chunk order by centrality in the graph of shared words; by place where chunks are too many."""
    n = len(chunks)
    if n > most:
        return sorted(range(n), key=lambda i: min(i, 2 * (n - 1 - i)))
    sets = [set(content_words(c)) for c in chunks]
    vocab = {w: k for k, w in enumerate(sorted(set().union(*sets)))} if sets else {}
    m = np.zeros((n, max(1, len(vocab))), np.float32)
    for i, s in enumerate(sets):
        m[i, [vocab[w] for w in s]] = 1
    size = np.log(np.maximum(2.0, m.sum(axis=1)))
    w = (m @ m.T) / (size[:, None] + size[None, :])
    np.fill_diagonal(w, 0)
    out = w.sum(axis=1)
    p = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    r = np.full(n, 1 / max(1, n))
    for _ in range(rounds):
        r = (1 - damping) / max(1, n) + damping * (p.T @ r)
    return order_desc(np.round(r, 12).tolist())


def mmr(ranked: list[int], chunks: list[str], keep: int, weight: float = 0.7) -> list[int]:
    """Best first, each next one the best of relevance less its likeness to those taken."""
    sets = [set(words(c)) for c in chunks]
    rel = {i: 1 - pos / max(1, len(ranked)) for pos, i in enumerate(ranked)}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    taken: list[int] = []
    rest = list(ranked)
    while rest and len(taken) < keep:
        best = max(rest, key=lambda i: (weight * rel[i] - (1 - weight) * max([like(i, j) for j in taken] or [0.0]), -i))
        taken.append(best)
        rest.remove(best)
    return taken


def u_shape(ranked: list[int]) -> list[int]:
    """The best chunks at both ends, the worst in the middle."""
    return ranked[::2] + ranked[1::2][::-1]


def sentences(text: str) -> list[str]:
    return [s for s in re.findall(r"[^.!?。！？\n]*(?:[.!?。！？]+(?=\s|$)|\n|$)\s*", text) if s]


def chunks_of(text: str, size: int = 1200) -> list[str]:
    """Paragraphs, or topic tiles, or lines; joined they are the text."""
    parts = re.findall(r".+?(?:\n\s*\n|\Z)", text, re.S)
    if len(parts) > 1:
        return parts
    tiles = texttile(text, size)
    return tiles if len(tiles) > 1 else re.findall(r"[^\n]*\n|[^\n]+\Z", text)


def texttile(text: str, most: int = 1200, block: int = 2, least: int = 6, shortest: int = 2) -> list[str]:
    """Sentences grouped between valleys of word likeness of the blocks before and after."""
    ss = sentences(text)
    if len(ss) < least:
        return [text]
    bags = [Counter(content_words(s)) for s in ss]

    def cos(a: Counter, b: Counter) -> float:
        na, nb = (math.sqrt(sum(v * v for v in c.values())) for c in (a, b))
        return sum(v * b[w] for w, v in a.items()) / (na * nb) if na and nb else 0.0

    sim = [cos(sum(bags[max(0, i - block) : i], Counter()), sum(bags[i : i + block], Counter())) for i in range(1, len(ss))]
    depth = []
    for i, s in enumerate(sim):
        left, right = i, i
        while left and sim[left - 1] >= sim[left]:
            left -= 1
        while right < len(sim) - 1 and sim[right + 1] >= sim[right]:
            right += 1
        depth.append(sim[left] - s + sim[right] - s)
    mean = sum(depth) / len(depth)
    cut = mean + 0.5 * math.sqrt(sum((d - mean) ** 2 for d in depth) / len(depth))
    low = 0.6 * sum(sim) / len(sim)
    out: list[list[str]] = [[ss[0]]]
    for i in range(1, len(ss)):
        valley = depth[i - 1] > cut and sim[i - 1] <= low and len(out[-1]) >= shortest and len(ss) - i >= shortest
        if valley or sum(map(len, out[-1])) + len(ss[i]) > most:
            out.append([])
        out[-1].append(ss[i])
    return ["".join(t) for t in out]


def protected(chunks: list[str]) -> set[int]:
    """Chunks that report a failure, and the indented ones that follow them."""
    out, held = set(), False
    for i, c in enumerate(chunks):
        if _FAIL.search(c):
            held = True
        elif not c[:1] in (" ", "\t"):
            held = False
        if held:
            out.add(i)
    return out


def prune_sentences(parts: list[str], query: list[str], ratio: float = 0.35) -> list[int]:
    """Sentences with query words, their neighbours, ends and failures; the least relevant go first to meet the ratio."""
    asked, n = {w for w in query if len(w) >= 2}, len(parts)
    score = [len(asked.intersection(words(p))) for p in parts]
    if not asked or not any(score):
        return list(range(n))
    hold = protected(parts) | {0, n - 1}
    keep = {i for i in range(n) if i in hold or any(0 <= j < n and score[j] for j in (i - 1, i, i + 1))}
    target = max(1, math.ceil(n * ratio))
    best = max(range(n), key=lambda i: (score[i], i))
    for i in sorted(keep - hold - {best}, key=lambda i: (score[i], i)):
        if len(keep) <= target:
            break
        keep.discard(i)
    return sorted(keep)


def prune_chunks(parts: list[str], query: list[str], ratio: float = 0.5) -> list[int]:
    """A budgeted, diverse choice of chunks; first and last stay."""
    scores = expanded(parts, query, bm25(parts, query)) if query else []
    ranked = order_desc(scores) if any(scores) else textrank(parts)
    n = len(parts)
    cost = [max(1, len(words(p))) for p in parts]
    rel = [0.0] * n
    for pos, i in enumerate(ranked):
        rel[i] = (n - pos) / n
    if 0 < ratio < 1:
        budget = math.ceil(sum(cost) * ratio)
    else:
        budget = sum(cost[i] for i in ranked[: optimal_keep(parts, 1, n)])
    kept = celf([pairs(p) for p in parts], cost, rel, max(budget, min(cost)))
    return sorted({0, n - 1, *kept, *protected(parts)})


def rebuild(parts: list[str], kept: list[int]) -> str:
    """Kept parts in order, with a mark for each dropped run."""
    out, last, chosen = [], -1, set(kept)
    for i in sorted(chosen):
        if i > last + 1:
            out.append(f"[… {i - last - 1} parts omitted …]\n")
        out.append(parts[i])
        last = i
    return "".join(out)

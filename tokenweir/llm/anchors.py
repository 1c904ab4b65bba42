"""Content anchors of byte strings: window minima of k-gram hashes.

A window of WINDOW bytes has one anchor, the leftmost of its k-grams with the smallest
hash, whatever stands around it; equal windows have the same anchor at the same place. Consecutive windows of one
anchor form a run, so a text of n bytes has about n / 35 runs.
"""

from __future__ import annotations

import numpy as np

WINDOW = 100
GRAM = 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return v ^ (v >> np.uint64(32))


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A hash of the k bytes from each position on; k is a power of two."""
    with np.errstate(over="ignore"):
        h, step, level = _BYTE[data], 1, 0
        while step < k:
            h = h[:-step] * _MUL[level] + h[step:] if len(h) > step else h[:0]
            step, level = 2 * step, level + 1
    return mixed(h)


def leftmost_min(v: np.ndarray, w: int) -> np.ndarray:
    """Per window of w values, the place of its smallest value, the leftmost of equals."""

    def better(m, p, m2, p2):
        right = m2 < m
        return np.where(right, m2, m), np.where(right, p2, p)

    span, m, p = 1, v, np.arange(len(v), dtype=np.int32 if len(v) < 1 << 31 else np.int64)
    while 2 * span <= w:
        m, p = better(m[:-span], p[:-span], m[span:], p[span:])
        span *= 2
    n = len(v) - w + 1
    return better(m[:n], p[:n], m[w - span : w - span + n], p[w - span : w - span + n])[1] if w > span else p


def runs(data: np.ndarray, at: np.ndarray, window: int = WINDOW, k: int = GRAM):
    """Per run: document, first window start, number of windows, anchor place, anchor hash.

    Whole hashes are compared, so the anchor of a window depends on its own bytes alone.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return empty, empty, empty, empty, empty.view(np.uint64)
    h = gram_hashes(data, k)
    n = len(data) - window + 1
    anchor = leftmost_min(h, window - k + 1)[:n]
    valid = np.zeros(len(data) + 1, np.int32)
    length = at[1:] - at[:-1]
    long = length >= window
    np.add.at(valid, at[:-1][long], 1)
    np.add.at(valid, at[1:][long] - window + 1, -1)
    anchor = np.where(np.cumsum(valid)[:n] > 0, anchor, -1)
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(edge, n))
    real = anchor[edge] >= 0
    lo, size, a = edge[real], size[real], anchor[edge[real]].astype(np.int64)
    return np.searchsorted(at, lo, side="right") - 1, lo, size, a, h[a]


def prefix_hash(data: np.ndarray, base: np.uint64 = _MUL[14]) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all prefixes, modulo 2**64 over random byte values, and the powers."""
    n = len(data)
    powers = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        powers[1:] = np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)
        # sum of byte * base**(n - 1 - i), scaled so that a span's hash is H[j] - H[i] * base**(j - i)
        inverse = pow(int(base), -1, 1 << 64)
        back = np.ones(n + 1, np.uint64)
        back[1:] = np.cumprod(np.full(n, np.uint64(inverse), np.uint64), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * back[1:], dtype=np.uint64)])
        return sums * powers, powers


def span_hash(prefix: np.ndarray, powers: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return prefix[j] - prefix[i] * powers[j - i]

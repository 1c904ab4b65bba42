"""Quality rules: base counts and a hashed n-gram logistic regression with fixed thresholds.

Words, word pairs and character n-grams are hashed to 2**BITS buckets; a document's
features are bucket shares per family. Weights are trained by logistic regression on a
bounded sample of labelled rows (SAMPLE_ROWS rows and SAMPLE_BYTES bytes of whole texts,
chosen by hash of doc_id), then calibrated by Platt scaling on the sample's last fifth.
Scoring runs in Arrow batches over every whole text.

Defined cases: null text has no words and fails the base rules; a very long text is a slice
of its own and counts whole; a probability of just KEEP_AT keeps; repeated rows are scored
each; labels that are null are left out, of several labels of a doc_id the largest counts
and of several texts of a labelled doc_id the smallest; without labels of both kinds the
verdict is that of the base rules; an empty table gives no rows; other columns pass through
`score_quality` untouched and result columns win over columns of their name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tokenweir.llm.arrowtext import SLICE_BYTES, gram_valid, is_space, segment_sum, slices, word_starts

BITS = 16
SCALE = 50.0
GRAMS = (2, 3, 4)
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 1 << 25
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_AT = 0.5
WINDOW = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def feature_families(data: np.ndarray, at: np.ndarray, ids: np.ndarray, hashes: np.ndarray, word_at: np.ndarray):
    """(bucket, n + 1 offsets) of each family: words, word pairs, character n-grams."""
    w = hashes[ids] if len(ids) else np.zeros(0, np.uint32)
    yield _bucket(w), word_at
    if len(w) > 1:
        pair = w[:-1] * np.uint32(31) + w[1:] * np.uint32(17)
        ok = np.ones(len(pair), dtype=bool)
        inner = word_at[1:-1]
        ok[inner[(inner > 0) & (inner <= len(pair))] - 1] = False
        kept = np.concatenate([[0], np.cumsum(ok)])
        yield _bucket(pair[ok]), kept[np.minimum(word_at, len(pair))]
    else:
        yield np.zeros(0, np.int64), np.zeros_like(word_at)
    x = data.astype(np.uint32)
    h = x.copy()
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(16777619) + x[n - 1 :] if len(h) else h
        if n in GRAMS:
            ok = gram_valid(len(data), at, n)[: len(h)]
            kept = np.concatenate([[0], np.cumsum(ok)])
            yield _bucket(h[ok] + np.uint32(n * 40503)), kept[np.minimum(at, len(h))]


def words_of(data: np.ndarray, at: np.ndarray):
    """Word ids of a slice, the distinct words' hashes, and word offsets per document."""
    raw = data.tobytes()
    seen: dict[bytes, int] = {}
    ids: list[int] = []
    word_at = np.zeros(len(at), np.int64)
    for i in range(len(at) - 1):
        ids.extend([seen.setdefault(w, len(seen)) for w in raw[at[i] : at[i + 1]].split()])
        word_at[i + 1] = len(ids)
    hashes = np.fromiter((zlib.crc32(w) for w in seen), dtype=np.uint32, count=len(seen))
    return np.asarray(ids, dtype=np.int64), hashes, word_at


def repeat_words(ids: np.ndarray, word_at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per document, words in a window of `window` words that the document holds twice or more."""
    n_docs = len(word_at) - 1
    if len(ids) < window:
        return np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(word_at))
    m = len(ids) - window + 1
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        h = np.zeros(m, np.uint64)
        for k in range(window):
            h = h * np.uint64(0x100000001B3) + x[k : k + m]
        h = (h ^ (doc[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x2545F4914F6CDD1D)
    inside = doc[:m] == doc[window - 1 :]
    s = np.sort(h[inside])
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(n_docs, np.int64)
    hit = np.flatnonzero(inside & (twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h))
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return segment_sum((np.cumsum(cover[:-1]) > 0).astype(np.int64), word_at)


def dup_lines(data: np.ndarray, at: np.ndarray) -> list[int]:
    raw, out = data.tobytes(), []
    for i in range(len(at) - 1):
        lines = raw[at[i] : at[i + 1]].split(b"\n")
        if len(lines) > len(set(lines)):
            worded = [x for x in lines if x.split(None, 1)]
            out.append(len(worded) - len(set(worded)))
        else:
            out.append(0)
    return out


def base_counts(data: np.ndarray, at: np.ndarray, ids: np.ndarray, word_at: np.ndarray) -> dict[str, np.ndarray]:
    letter = ~is_space(data) & ((data & 0xC0) != 0x80)
    return {
        "n_words": segment_sum(word_starts(data, at).astype(np.int64), at),
        "word_chars": segment_sum(letter.astype(np.int64), at),
        "n_symbols": segment_sum(_SYMBOL[data].astype(np.int64), at),
        "n_dup_lines": np.asarray(dup_lines(data, at), dtype=np.int64),
        "n_repeat_words": repeat_words(ids, word_at),
    }


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def base_failed(texts: list[bytes]) -> np.ndarray:
    """The base verdict of texts; the model is trained on what the base rules let pass."""
    out = [np.zeros(0, bool)]
    for _, _, data, at in slices(pa.array(texts, type=pa.binary())):
        ids, _, word_at = words_of(data, at)
        out.append(failed({"n_words": np.diff(word_at), "n_repeat_words": repeat_words(ids, word_at)}))
    return np.concatenate(out)


class QualityModel:
    """Weights per family and bucket, bias, and Platt scale; p = 1 / (1 + exp(-(a * z + b)))."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def probability(self, data, at, ids, hashes, word_at) -> np.ndarray:
        z = np.full(len(at) - 1, self.bias)
        for f, (bucket, off) in enumerate(feature_families(data, at, ids, hashes, word_at)):
            z += SCALE * segment_sum(self.weights[f][bucket], off) / np.maximum(1, np.diff(off))
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 150, l2: float = 1e-4, rate: float = 0.05) -> QualityModel | None:
    """Logistic regression by Adam on the first four fifths, Platt scaling on the rest."""
    if len(set(labels.tolist())) < 2:
        return None
    families = 2 + len(GRAMS)
    idx, val, rows = [], [], []
    col = pa.array(texts, type=pa.binary())
    for i, j, data, at in slices(col, SLICE_BYTES // 4):
        ids, hashes, word_at = words_of(data, at)
        for f, (bucket, off) in enumerate(feature_families(data, at, ids, hashes, word_at)):
            n = np.diff(off)
            key = (np.repeat(np.arange(j - i), n) << BITS) | bucket
            u, c = np.unique(key, return_counts=True)
            r = u >> BITS
            rows.append((r + i).astype(np.int32))
            idx.append(((u & ((1 << BITS) - 1)) + (f << BITS)).astype(np.int32))
            val.append((SCALE * c / n[r]).astype(np.float32))
    rows, idx, val = np.concatenate(rows), np.concatenate(idx), np.concatenate(val)
    cut = max(2, len(texts) * 4 // 5)
    if len(set(labels[:cut].tolist())) < 2 or len(set(labels[cut:].tolist())) < 2:
        cut = len(texts)
    train = rows < cut
    tr, ti, tv = rows[train], idx[train], val[train]
    y = labels[:cut].astype(np.float64)
    w, b = np.zeros(families << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(tr, weights=tv * w[ti], minlength=cut) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / cut
        grad = np.bincount(ti, weights=tv * g[tr], minlength=len(w)) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        lr = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= lr * m / (np.sqrt(v) + 1e-8)
        b -= lr * mb / (np.sqrt(vb) + 1e-8)
    z = np.bincount(rows, weights=val * w[idx], minlength=len(texts)) + b
    held = slice(cut, None) if cut < len(texts) else slice(None)
    pa_, pb_ = platt(z[held], labels[held].astype(np.float64))
    return QualityModel(w.reshape(families, 1 << BITS).astype(np.float32), float(b), pa_, pb_)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Newton steps for p = sigmoid(a z + b) with Platt's smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return (float(max(a, 1e-3)), float(b))


#: A text longer than this share of the byte bound is not trained on, so that one text can't be the sample.
LONGEST_SHARE = 16


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int, keep=None
) -> DataFrame:
    """At most `rows` labelled documents, once per doc_id: doc_id, label, text, in one partition.

    Rows come in the order of a hash of their doc_id. Of several texts of a doc_id the
    smallest is taken before the rows meet, so that an id costs a row per task at most.
    """
    picked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        picked = picked.filter(keep(F.col("doc_id")))
    picked = picked.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select("doc_id", text.alias("text")).filter(F.octet_length("text") <= max_bytes // LONGEST_SHARE)
    once = given.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "__label").agg(F.min("text").alias("text"))
    return once.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")


def read_sample(batches: Iterator[pa.RecordBatch], max_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """Whole texts in the order given, up to the first that goes beyond max_bytes; equal texts once.

    No more is held than these texts and one batch.
    """
    texts, labels, seen, size = [], [], set(), 0
    for batch in batches:
        for y, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            text = text.as_py() or b""
            if text in seen:
                continue
            size += len(text)
            if size > max_bytes:
                return texts, np.asarray(labels, dtype=np.int64)
            seen.add(text)
            texts.append(text)
            labels.append(1 if y else 0)
    return texts, np.asarray(labels, dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel | None:
    """Fits in one task on the bounded sample; only the weights (2**BITS per family) come back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = read_sample(batches, sample_bytes)
        passed = ~base_failed(texts)
        texts, y = [t for t, ok in zip(texts, passed) if ok], y[passed]
        model = fit(texts, y) if len(texts) else None
        if model is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.a]), pa.array([model.b])],
                names=["w", "bias", "a", "b"],
            )

    sample = labelled_sample(docs, labels, "quality", sample_rows, sample_bytes)
    got = sample.mapInArrow(work, "w binary, bias double, a double, b double").collect()
    if not got:
        return None
    w = np.frombuffer(bytes(got[0]["w"]), dtype=np.float32).reshape(2 + len(GRAMS), 1 << BITS)
    return QualityModel(w, got[0]["bias"], got[0]["a"], got[0]["b"])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def score_quality(docs: DataFrame, model: QualityModel | None, columns: list[str] | None = None) -> DataFrame:
    """`columns` of docs (default: doc_id) with counts, base verdict, probability and verdict."""
    names = [f.strip().split()[0] for f in RESULT.split(",")]
    columns = [c for c in (columns or ["doc_id"]) if c not in names]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            kept = [batch.column(k) for k in range(len(columns))]
            for i, j, data, at in slices(batch.column(len(columns)), SLICE_BYTES // 2):
                ids, hashes, word_at = words_of(data, at)
                c = base_counts(data, at, ids, word_at)
                bad = failed(c)
                p = model.probability(data, at, ids, hashes, word_at) if model else np.ones(j - i)
                out = [*c.values(), bad, p, ~bad & (p >= KEEP_AT)]
                yield pa.RecordBatch.from_arrays([*(k.slice(i, j - i) for k in kept), *map(pa.array, out)], names=[*columns, *names])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [RESULT])
    given = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("__text"))
    return given.mapInArrow(work, schema)

"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are presences of character n-grams (4 and 6 code points of the lower-cased text),
hashed to 2**BITS slots; all n-grams count, rare ones too. Each is scaled by its log-count
ratio r = ln(p / q), where p and q are its document shares in toxic and other texts, both
smoothed as if SMOOTH more texts, with the usual share of toxic ones, held it, and shrunk
by the evidence: little of it leaves r near 0, but no n-gram is dropped. Logistic regression
on the scaled features, toxic texts weighing as much as all others together, gives the score. Training uses a bounded sample of labelled rows (SAMPLE_ROWS,
SAMPLE_BYTES of whole texts, equal texts once); scoring reads every whole text in Arrow
batches.

Defined cases: null text is empty and scores as a text without features; a very long text
is a slice of its own and counts whole; a score of just PREDICT_AT predicts 1; null labels
are left out, of several labels of a doc_id the largest counts, of several texts of a
labelled doc_id the smallest; without both kinds of label every score is the smoothed share
of toxic labels; repeated rows are scored each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tokenweir.llm.arrowtext import slices
from tokenweir.llm.quality import labelled_sample, read_sample

GRAMS = (4, 6)
BITS = 22
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 1 << 25
PREDICT_AT = 0.7
SMOOTH = 1.0
DOUBT = 50.0
#: Passes over the sample, at least and at most, and the (text, slot) pairs that they visit in all.
STEPS, VISITS = (80, 1000), 2_000_000_000
PENALTY = 1e-4
#: Texts, or slots, whose pairs are gathered at once while fitting.
CHUNK_TEXTS, CHUNK_SLOTS = 256, 1 << 17


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


def gram_slots(text: str) -> np.ndarray:
    """The slots of all character n-grams of a text, repeats included."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    h, out = x, []
    for n in range(2, max(GRAMS) + 1):
        if len(x) < n:
            break
        h = h[:-1] * np.uint32(16777619) + x[n - 1 :]
        if n in GRAMS:
            out.append(((h + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Presence:
    """Each slot of a text once; the scratch table is kept between texts."""

    def __init__(self):
        self.mark = np.zeros(1 << BITS, np.int32)

    def slots(self, text: str) -> np.ndarray:
        all_ = gram_slots(text)
        at = np.arange(len(all_), dtype=np.int32)
        self.mark[all_] = at  # of equal slots one position stays
        return all_[self.mark[all_] == at]


class ToxicModel:
    """coef (log-count ratio times weight) per slot, and bias."""

    def __init__(self, coef: np.ndarray, bias: float):
        self.coef, self.bias = coef, bias

    def score(self, texts: list[str]) -> np.ndarray:
        one = Presence()
        z = np.array([self.coef[one.slots(t)].sum(dtype=np.float64) for t in texts]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_count_ratio(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """ln of the smoothed share among n1 texts over that among n0, shrunk towards 0 by the evidence.

    From document counts; z is the two-proportion statistic, z2 / (z2 + DOUBT) the shrinkage.
    """
    p1, p0 = SMOOTH * n1 / (n1 + n0), SMOOTH * n0 / (n1 + n0)
    ratio = np.log((c1 + p1) / (n1 + p1)) - np.log((c0 + p0) / (n0 + p0))
    p = (c1 + c0) / (n1 + n0)
    z2 = (c1 / n1 - c0 / n0) ** 2 / np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12)
    return ratio * z2 / (z2 + DOUBT)


def fit(texts: list[str], y: np.ndarray, rate: float = 0.1, penalty: float = PENALTY) -> ToxicModel:
    """Adam on the penalised logistic loss; a small sample gets more passes."""
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return ToxicModel(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    one, n, n1 = Presence(), len(y), int(y.sum())
    slots = [one.slots(t) for t in texts]
    size = np.array([len(x) for x in slots])
    some = np.flatnonzero(size)
    head = np.concatenate([[0], np.cumsum(size[some])])
    slots = np.concatenate(slots)
    by_slot = np.argsort(slots, kind="stable")
    owner = np.repeat(some, size[some]).astype(np.int32)[by_slot]
    used, start = np.unique(slots[by_slot], return_index=True)
    del by_slot
    start = np.append(start, len(owner))

    def pulled(g: np.ndarray) -> np.ndarray:
        """Per used slot, the sum of g over the texts that hold it."""
        out = np.empty(len(used))
        for k in range(0, len(used), CHUNK_SLOTS):
            at = start[k : k + CHUNK_SLOTS + 1]
            out[k : k + CHUNK_SLOTS] = np.add.reduceat(g[owner[at[0] : at[-1]]], at[:-1] - at[0])
        return out

    def margins(theta: np.ndarray) -> np.ndarray:
        """Per text, the sum of theta over the slots that it holds."""
        table, out = np.zeros(1 << BITS, np.float32), np.zeros(n)
        table[used] = theta
        for k in range(0, len(some), CHUNK_TEXTS):
            at = head[k : k + CHUNK_TEXTS + 1]
            out[some[k : k + CHUNK_TEXTS]] = np.add.reduceat(table[slots[at[0] : at[-1]]], at[:-1] - at[0], dtype=np.float64)
        return out

    c1 = pulled(y.astype(np.float64))
    r = log_count_ratio(c1, np.diff(start) - c1, n1, n - n1)
    w, b = np.zeros(len(used)), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y == 1, (n - n1) / n1, 1.0)
    weight /= weight.sum()
    for t in range(1, min(max(VISITS // (2 * len(slots)), STEPS[0]), STEPS[1]) + 1):
        g = (1 / (1 + np.exp(-np.clip(margins(r * w) + b, -30, 30))) - y) * weight
        grad = r * pulled(g) + penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        now = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= now * m / (np.sqrt(v) + 1e-8)
        b -= now * mb / (np.sqrt(vb) + 1e-8)
    coef = np.zeros(1 << BITS, np.float32)
    coef[used] = r * w
    return ToxicModel(coef, float(b))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> ToxicModel:
    """Fits in one task on the bounded sample of rows that are not held out; 2**BITS numbers come back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = read_sample(batches, sample_bytes)
        model = fit([t.decode("utf-8", "replace") for t in texts], y)
        yield pa.RecordBatch.from_arrays([pa.array([model.coef.tobytes()], pa.binary()), pa.array([model.bias])], names=["c", "b"])

    sample = labelled_sample(docs, labels, "toxic", sample_rows, sample_bytes, lambda i: ~held_out(i))
    got = sample.mapInArrow(work, "c binary, b double").collect()
    if not got:
        return fit([], np.zeros(0, np.int64))
    return ToxicModel(np.frombuffer(bytes(got[0]["c"]), np.float32), got[0]["b"])


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j, data, at in slices(batch.column(2)):
                raw, ends = data.tobytes(), at.tolist()
                p = model.score([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(p), pa.array((p >= PREDICT_AT).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    given = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return given.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")


def crc_fold(doc_id) -> bool:
    """The fold of one id in plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1

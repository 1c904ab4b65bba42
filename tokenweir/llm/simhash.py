"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at distance 3 or less share a midpoint: one within 1 bit of one of them and
within 2 bits of the other. Every fingerprint emits all variants within one bit; those
with an odd number of set bits also emit variants two bits away. That is enough, since
fingerprints at distance 3 differ in parity, and of three differing bits two lie in one
half of the word, so only pairs of bits within one half are needed. Variants are shuffled
packed by target partition: each fingerprint stands there once with the list of its
flips. Within a variant all members link to one that is at most one bit away from it;
every such link is verified by counting differing bits. Per task, links are reduced to
a spanning forest, so a dense group costs no more than its members.

Equal fingerprints are collapsed first (a partial aggregate), so thousands of copies are
one fingerprint. Defined cases: null or wordless text has fingerprint zero and links like
any other; a very long text is read whole, in a slice of its own; a bit that is set in just
half of the hashes is 0; null doc_ids and repeated rows get rows of their own, and a
component is named by its smallest doc_id that is not null (null if it has none); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tokenweir.llm.arrowtext import slices
from tokenweir.llm.common import materialize
from tokenweir.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3

_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_HALF_PAIRS = [(i, j) for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
#: Flips by number: 0 none, 1-64 one bit, the rest two bits of one half.
FLIPS = np.concatenate([np.zeros(1, np.uint64), _ONE, np.array([_ONE[i] | _ONE[j] for i, j in _HALF_PAIRS], dtype=np.uint64)])
_WEIGHT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    return _WEIGHT[np.ascontiguousarray(x).view(np.uint16).reshape(len(x), 4)].sum(axis=1)


def fingerprint(text: bytes) -> int:
    """Bit k is set if it is set in over half of the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    line, f = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return f(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[: -SHINGLE]])
    h = np.fromiter((f(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist())), dtype=np.uint64, count=len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((_ONE[2 * ones > len(h)]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long, the bits of the unsigned fingerprint) for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column(1)):
                raw, ends = data.tobytes(), at.tolist()
                out = np.fromiter((fingerprint(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])), dtype=np.uint64, count=j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, fp long")


def _mixed(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (v ^ (v >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return v ^ (v >> np.uint64(33))


def balls(fps: DataFrame, parts: int) -> DataFrame:
    """(part, body): packed blocks of fingerprints with the flips that fall in that part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(every), 2048):
                fp = every[k : k + 2048]
                odd = popcount(fp) % 2 == 1
                which = np.concatenate([np.repeat(np.flatnonzero(~odd), 65), np.repeat(np.flatnonzero(odd), len(FLIPS))])
                flip = np.concatenate([np.tile(np.arange(65), (~odd).sum()), np.tile(np.arange(len(FLIPS)), odd.sum())]).astype(np.uint16)
                part = (_mixed(fp[which] ^ FLIPS[flip]) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((which, part))
                part, which, flip = part[order], which[order], flip[order]
                cut = np.searchsorted(part, np.arange(parts + 1))
                ids, bodies = [], []
                for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                    w, f = which[cut[p] : cut[p + 1]], flip[cut[p] : cut[p + 1]]
                    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                    counts = np.diff(np.append(first, len(w))).astype(np.uint16)
                    ids.append(p)
                    bodies.append(np.int32(len(first)).tobytes() + fp[w[first]].tobytes() + counts.tobytes() + f.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(bodies, pa.binary())], names=["part", "body"])

    return fps.select("fp").mapInArrow(work, "part int, body binary")


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, np.int32, 1)[0])
    fp = np.frombuffer(body, np.uint8, 8 * n, 4).copy().view(np.uint64)
    counts = np.frombuffer(body, np.uint8, 2 * n, 4 + 8 * n).copy().view(np.uint16)
    flip = np.frombuffer(body, np.uint8, 2 * int(counts.sum(dtype=np.int64)), 4 + 10 * n).copy().view(np.uint16)
    return np.repeat(fp, counts), flip


def star_links(fp: np.ndarray, flip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the members of each variant, reduced to a spanning forest."""
    variant = fp ^ FLIPS[flip]
    order = np.lexsort((flip > 64, variant))
    v, f, near = variant[order], fp[order], flip[order] <= 64
    head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    size = np.diff(np.append(head, len(v)))
    some = (size > 1) & near[head]
    center = np.repeat(f[head[some]], size[some])
    pos = np.repeat(head[some], size[some]) + np.arange(int(size[some].sum())) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
    other = f[pos]
    ok = (center != other) & (popcount(center ^ other) <= RADIUS)
    return forest(center[ok], other[ok])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, by union-find over the distinct pairs."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    pairs = np.unique(np.minimum(x, y) * len(nodes) + np.maximum(x, y))
    parent = list(range(len(nodes)))
    keep = []
    for k, (i, j) in enumerate(zip((pairs // len(nodes)).tolist(), (pairs % len(nodes)).tolist())):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep.append(k)
    kept = pairs[keep]
    return nodes[kept // len(nodes)], nodes[kept % len(nodes)]


def links(packed: DataFrame, parts: int) -> DataFrame:
    """(a, b): verified links between fingerprints (as longs), a spanning forest per part.

    A part's size is bounded by the choice of `parts`; blocks of several parts that share
    a task are worked on one part after another.
    """

    def work(blocks: pa.Table) -> pa.Table:
        pieces = [_unpack(x.as_py()) for x in blocks.column("body")]
        a, b = star_links(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]))
        return pa.Table.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return packed.repartition(parts, "part").groupBy("part").applyInArrow(work, "a long, b long")


#: Fingerprints per part: about 560 variants each on average.
PART_FINGERPRINTS = 4000
#: Fingerprints whose balls a task makes; the number is given, so that adaptive execution doesn't join small tasks.
BALL_FINGERPRINTS = 4096


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable, itself included) for every row."""
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    n = distinct.count()
    parts = max(8, -(-n // PART_FINGERPRINTS))
    found = links(balls(distinct.repartition(max(8, -(-n // BALL_FINGERPRINTS)), "fp"), parts), parts)
    return prints.join(named_components(distinct, components(found)), prints["fp"] == F.col("__fp"), "left").select("doc_id", "fp", "component_id")


def named_components(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(__fp, component_id): for every node (fp, rep) the smallest rep of its component.

    Components are found over the nodes themselves, since one doc_id may stand for several.
    """
    rooted = materialize(
        nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")), "rooted"
    )
    least = rooted.groupBy(F.col("root").alias("__root")).agg(F.min("rep").alias("component_id"))
    return rooted.join(least, F.col("root") == F.col("__root")).select(F.col("fp").alias("__fp"), "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

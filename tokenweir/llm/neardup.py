"""Embedding near-duplicates by int8 tile products with per-vector error bounds.

Every vector is scaled by its largest component, normalised and quantised to int8 with a
scale of its own; the norm of the quantisation error is kept. For unit vectors u = s q + e
the cosine differs from s_a s_b (q_a . q_b) by at most |e_a| + |e_b| + |e_a| |e_b|, so a pair
whose integer product stays below the threshold by more than that can't link. All pairs of
blocks are worked on as tiles (each pair of blocks once, integer products exact in
float32). Only codes travel to the tiles: the int8 codes and those of the rest that they
leave, quantised the same way. Pairs possibly above the threshold are computed again with
both codes, whose bound is some 250 times tighter; what that leaves open is recomputed in
double precision from the vectors themselves, by two joins. Tiles return link counts per
vector and a spanning forest, never all pairs.

Equal vectors are collapsed first by a partial aggregate. Defined cases: null, empty or zero
vectors, those with null or non-finite components and rows without a vec_id link with
nothing; vectors of different length don't link; a repeated vec_id keeps a row each, and a
class takes part under its smallest vec_id; pairs exactly at the threshold link; very long
vectors are exact too (products are summed in parts); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tokenweir.llm.common import materialize
from tokenweir.llm.components import components
from tokenweir.llm.simhash import named_components

THRESHOLD = 0.95
BLOCK = 8192
SUB = 512
#: Products of int8 vectors up to this length are exact in float32.
EXACT_DIMS = (1 << 24) // (127 * 127)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of what they leave); the norms are rounded up."""
    s = np.maximum(np.abs(u).max(axis=1) / 127, 1e-300)
    q = np.rint(u / s[:, None])
    e = np.sqrt(((u - s[:, None] * q) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), s, e


def codes(u: np.ndarray) -> np.ndarray:
    """One record per unit vector: coarse and fine int8 codes, their scales and error norms."""
    q, s, e = quantise(u)
    r, t, f = quantise(u - s[:, None] * q)
    out = np.empty(len(u), code_type(u.shape[1]))
    for name, v in (("q", q), ("r", r), ("s", s), ("t", t), ("e", e), ("f", f)):
        out[name] = v
    return out


def code_type(dims: int) -> np.dtype:
    """A packed vector: class, rows of the class, codes, scales and error norms."""
    return np.dtype([("rep", "<i8"), ("mult", "<i8"), ("s", "<f8"), ("t", "<f8"), ("e", "<f8"), ("f", "<f8"), ("q", "i1", (dims,)), ("r", "i1", (dims,))])


def products(qa: np.ndarray, qb: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes."""
    if qa.shape[1] <= EXACT_DIMS:
        return qa.astype(np.float32) @ qb.astype(np.float32).T
    return sum(
        (qa[:, k : k + EXACT_DIMS].astype(np.float32) @ qb[:, k : k + EXACT_DIMS].astype(np.float32).T).astype(np.float64)
        for k in range(0, qa.shape[1], EXACT_DIMS)
    )


def linked_pairs(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) of pairs that reach the threshold (sure) or may; a and b as from codes; within one block i < j."""
    order = np.argsort(b["s"], kind="stable")
    for k in range(0, len(order), SUB):
        cols = order[k : k + SUB]
        p = products(a["q"], b["q"][cols])
        slack = a["e"] + b["e"][cols].max() * (1 + a["e"])
        low = np.where(threshold > slack, (threshold - slack) / (a["s"] * b["s"][cols].max()), -np.inf)
        i, j = np.nonzero(p >= np.floor(low)[:, None].astype(p.dtype))
        j = cols[j]
        if same:
            i, j = i[i < j], j[i < j]
        for m in range(0, len(i), 1 << 15):
            x, y = a[i[m : m + (1 << 15)]], b[j[m : m + (1 << 15)]]
            near = np.einsum("ij,ij->i", fine(x), fine(y))
            # besides the codes' error, a rounding error of the sums and of the unit vectors themselves
            bound = x["f"] + y["f"] + x["f"] * y["f"] + 1e-13 * (1 + x["q"].shape[1])
            may = np.flatnonzero(near >= threshold - bound)
            yield i[m + may], j[m + may], near[may] >= threshold + bound[may]


def fine(x: np.ndarray) -> np.ndarray:
    return x["s"][:, None] * x["q"] + x["t"][:, None] * x["r"]


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the links but the roots."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (label[x], label[y], x, y):
            np.minimum.at(new, at, m)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def tile_blocks(classes: DataFrame, blocks: int) -> DataFrame:
    """(tile, side, n, body): packed codes of one block for every tile they take part in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            mult = batch.column(1).to_numpy(zero_copy_only=False)
            block = batch.column(2).to_numpy(zero_copy_only=False)
            off, values = vectors_of(batch.column(3))
            dims = np.diff(off)
            tiles, sides, counts, bodies = [], [], [], []
            for d in np.unique(dims).tolist():
                for i in np.unique(block[dims == d]).tolist():
                    rows = np.flatnonzero((dims == d) & (block == i))
                    packed = codes(unit(values[off[rows][:, None] + np.arange(d)]))
                    packed["rep"], packed["mult"] = reps[rows], mult[rows]
                    body = packed.tobytes()
                    for j in range(blocks):
                        lo, hi = min(i, j), max(i, j)
                        tiles.append(f"{d}:{lo}:{hi}")
                        sides.append(int(i == hi and lo != hi))
                        counts.append(len(rows))
                        bodies.append(body)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tiles, pa.string()), pa.array(sides, pa.int32()), pa.array(counts, pa.int32()), pa.array(bodies, pa.binary())],
                names=["tile", "side", "n", "body"],
            )

    return classes.select("fp", "mult", "block", "embedding").mapInArrow(work, "tile string, side int, n int, body binary")


def vectors_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values (double) of a list column."""
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)


#: Links as they leave the tiles: counts (n vectors linked with a), edges of a tile's forest (a joined to b), open pairs.
COUNT, EDGE, OPEN = 0, 1, 2


def tile_links(tiles: DataFrame, n_tiles: int, threshold: float) -> DataFrame:
    """(kind, a, b, n): COUNT: n vectors are linked with a; EDGE: a and b are in one component; OPEN: a pair to recompute."""

    def table_of(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.Table:
        return pa.table({"kind": np.full(len(a), kind, np.int32), "a": a.astype(np.int64), "b": b.astype(np.int64), "n": n.astype(np.int64)})

    def work(table: pa.Table) -> pa.Table:
        side, body = table.column("side").to_pylist(), [x.as_py() for x in table.column("body")]
        dims, lo, hi = map(int, table.column("tile")[0].as_py().split(":"))
        pick = lambda s: np.concatenate([np.frombuffer(v, code_type(dims)) for v, w in zip(body, side) if w == s] or [np.empty(0, code_type(dims))])
        first = pick(0)
        second = first if lo == hi else pick(1)
        links_a, links_b = np.zeros(len(first), np.int64), np.zeros(len(second), np.int64)
        none = np.zeros(0, np.int64)
        held, left = [(none, none)], [(none, none)]
        if len(first) and len(second):
            for x, y, sure in linked_pairs(first, second, lo == hi, threshold):
                left.append((first["rep"][x[~sure]], second["rep"][y[~sure]]))
                x, y = x[sure], y[sure]
                np.add.at(links_a, x, second["mult"][y])
                np.add.at(links_a if lo == hi else links_b, y, first["mult"][x])
                held.append(roots(first["rep"][x], second["rep"][y]))
        a, b = roots(*(np.concatenate(v) for v in zip(*held)))
        out = [table_of(EDGE, a, b, np.zeros(len(a))), table_of(OPEN, *(np.concatenate(v) for v in zip(*left)), np.zeros(sum(len(v[0]) for v in left)))]
        for rows, links in [(first, links_a)] if lo == hi else [(first, links_a), (second, links_b)]:
            some = links > 0
            out.append(table_of(COUNT, rows["rep"][some], rows["rep"][some], links[some]))
        return pa.concat_tables(out)

    return tiles.repartition(n_tiles, "tile").groupBy("tile").applyInArrow(work, "kind int, a long, b long, n long")


def recomputed(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(kind, a, b, n) of the OPEN pairs (a, b) whose cosine in double precision reaches the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ma, mb = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            (off, x), (other, y) = vectors_of(batch.column(4)), vectors_of(batch.column(5))
            ok = np.zeros(len(a), dtype=bool)
            for d in np.unique(np.diff(off)).tolist():
                rows = np.flatnonzero(np.diff(off) == d)
                span = np.arange(d)
                ok[rows] = np.einsum("ij,ij->i", unit(x[off[rows][:, None] + span]), unit(y[other[rows][:, None] + span])) >= threshold
            a, b, ma, mb = a[ok], b[ok], ma[ok], mb[ok]
            kind = np.repeat(np.array([EDGE, COUNT, COUNT], np.int32), len(a))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(np.concatenate([a, a, b])), pa.array(np.concatenate([b, a, b])), pa.array(np.concatenate([0 * mb, mb, ma]))],
                names=["kind", "a", "b", "n"],
            )

    side = lambda c: classes.select(F.col("fp").alias(c), F.col("mult").alias("m" + c), F.col("embedding").alias("e" + c))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb", "ea", "eb")
    return joined.mapInArrow(work, "kind int, a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    live = F.coalesce((F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id"), F.when(live, e).alias("embedding"))
    classes = materialize(
        rows.filter("embedding is not null")
        .groupBy("embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("mult"))
        .withColumn("fp", F.monotonically_increasing_id()),
        "classes",
    )
    n = classes.count()
    blocks = max(1, -(-n // block))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int"))
    n_tiles = blocks * (blocks + 1) // 2
    deal = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n_tiles, 20_000))
    tiles = materialize(tile_links(tile_blocks(dealt, blocks), deal, threshold), "links")
    found = tiles.union(recomputed(tiles.filter(F.col("kind") == OPEN), classes, threshold))
    counts = found.filter(F.col("kind") == COUNT).groupBy("a").agg(F.sum("n").alias("n"))
    named = named_components(classes, components(found.filter(F.col("kind") == EDGE).select("a", "b")))
    info = (
        classes.join(counts, F.col("fp") == F.col("a"), "left")
        .join(named, F.col("fp") == F.col("__fp"))
        .select(F.col("embedding").alias("__e"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), "component_id")
    )
    out = rows.join(info, rows["embedding"] == info["__e"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

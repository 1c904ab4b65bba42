"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a WINDOW-byte string that starts earlier (smaller key, or earlier in the
same document) covers it; what starts earlier is judged on the input. Steps:

1. Every window has a content anchor (see anchors.py); windows of one anchor form a run.
   Equal windows have equal anchors, so only runs of one anchor can repeat one another.
   Runs that equal an earlier one of their batch, byte by byte, are settled there, so
   copies cost a row per batch. The others travel without their bytes, packed, to the part
   of their anchor hash, only to find out which anchors several runs have.
2. The bytes of those runs are fetched, and the suffix sort decides: mergesort of the runs
   of an anchor, and then of all windows of runs that differ, within groups that share
   anchor and offset. Two suffixes are compared by binary search for their common extension
   over prefix polynomial hashes (eight steps at most), and neighbours found equal are
   verified byte by byte.
3. Anchors that very many documents share (found on a bounded sample of documents) would
   make groups too large for a task; their windows are dealt out singly by a hash of their
   own, after the batch has settled its own repeats, and sorted and verified like runs.

Defined cases: null or empty text has no bytes and removes nothing; texts below WINDOW
bytes never lose or cause anything; a very long text is a slice of its own; null or
repeated doc_ids count as documents of their own (nulls first, then by id and the SHA-256
of the text; of equal rows one is first); an empty table gives no rows; other columns,
whatever their names, stay in `__row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tokenweir.llm import anchors
from tokenweir.llm.anchors import WINDOW
from tokenweir.llm.arrowtext import SLICE_BYTES, flat, slices
from tokenweir.llm.common import materialize, release_shuffles, with_row_key

#: Runs per part of the first shuffle, windows' bytes per part of the second.
PART_RUNS = 200_000
PART_BYTES = 3 << 19
#: Documents looked at for anchors that very many share, and how many make it so.
HEAVY_DOCS = 20_000
HEAVY_COUNT = 60
FLUSH_RUNS = 1 << 19
#: Bytes of a suffix at most: a run's windows and one window more. Strings that collide by their structure have 1,024.
LONGEST = 2 * WINDOW
#: Bytes of text whose windows are hashed at once: some twenty 8-byte numbers a byte.
HASH_BYTES = 1 << 19

_RUN = np.dtype([("h", "<u8"), ("key", "<i8"), ("lo", "<u4"), ("n", "u1"), ("off", "u1")])
_WIN = np.dtype([("h", "<u8"), ("key", "<i8"), ("lo", "<u4")])
_DONE = np.dtype([("key", "<i8"), ("lo", "<u4"), ("n", "<u4")])


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _firsts(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """True, in `order`, where any of the columns differs from the row before."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return new


def slice_runs(data: np.ndarray, at: np.ndarray, keys: np.ndarray, heavy: np.ndarray):
    """(runs, windows of heavy anchors, done) of a slice of documents, each content once."""
    _, lo, n, a, h = anchors.runs(data, at)
    s = Suffixes(data)

    def once(kind: np.dtype, start: np.ndarray, n: np.ndarray, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = np.searchsorted(at, start, side="right") - 1
        key, place = keys[doc], start - at[doc]
        again = s.repeats(start, n + WINDOW - 1, alike(h, off, n), key, place)
        out = np.empty(len(start), kind)
        for field, v in (("h", h), ("key", key), ("lo", place), ("n", n), ("off", off)):
            if field in kind.names:
                out[field] = v
        return out[~again], _spans(key[again], place[again], n[again])

    hot = _member(heavy, h)
    run, done = once(_RUN, lo[~hot], n[~hot], h[~hot], (a - lo)[~hot])
    w, idx = _explode(lo[hot], n[hot])
    win, more = once(_WIN, w, np.ones(len(w), np.int64), window_hash(s, w, h[hot][idx]), np.zeros(len(w), np.int64))
    return run, win, np.concatenate([done, more])


def window_hash(s: Suffixes, start: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of single windows, from their bytes and their anchor's hash."""
    with np.errstate(over="ignore"):
        return anchors.mixed(s.span(start, WINDOW) + h * np.uint64(3))


def alike(h: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The group of runs of one anchor whose lengths and anchor places are the same."""
    return anchors.mixed(h ^ anchors.mixed((off * 256 + n).astype(np.uint64)))


def _explode(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx = np.repeat(np.arange(len(lo)), n)
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), idx


def _spans(key: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ranges of window starts (key, lo, n), joined where they touch."""
    out = np.empty(len(key), _DONE)
    if not len(key):
        return out
    order = np.lexsort((lo, key))
    key, lo, end = key[order], lo[order].astype(np.int64), (lo + n)[order].astype(np.int64)
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (lo[1:] > end[:-1])  # ranges of one document don't overlap
    head = np.flatnonzero(new)
    out = out[: len(head)]
    out["key"], out["lo"] = key[head], lo[head]
    out["n"] = end[np.append(head[1:], len(key)) - 1] - lo[head]
    return out


def packed(part: np.ndarray, kind: int, rows: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    head = np.flatnonzero(_firsts([part], np.arange(len(part))))
    ends = np.append(head[1:], len(part))
    return part[head].tolist(), [kind] * len(head), [rows[i:j].tobytes() for i, j in zip(head, ends)]


def run_blocks(keyed: DataFrame, parts: int, heavy: np.ndarray) -> DataFrame:
    """(part, kind, body) blocks: 0 runs, 1 windows, 2 settled repeats."""
    shared = keyed.sparkSession.sparkContext.broadcast(heavy)

    def flush(held):
        blocks: tuple[list, list, list] = ([], [], [])
        run, win, done = (np.concatenate(x) for x in zip(*held))
        for kind, rows, part in (
            (0, run, anchors.mixed(run["h"]) % np.uint64(parts)),
            (1, win, anchors.mixed(win["h"]) % np.uint64(parts)),
            (2, done, anchors.mixed(done["key"].astype(np.uint64)) % np.uint64(parts)),
        ):
            if len(rows):
                for mine, more in zip(blocks, packed(part.astype(np.int64), kind, rows)):
                    mine.extend(more)
        return pa.RecordBatch.from_arrays([pa.array(blocks[0], pa.int32()), pa.array(blocks[1], pa.int32()), pa.array(blocks[2], pa.binary())], names=["part", "kind", "body"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, at in slices(batch.column(1), HASH_BYTES):
                held.append(slice_runs(data, at, keys[i:j], shared.value))
                size += sum(map(len, held[-1]))
                if size >= FLUSH_RUNS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return keyed.select("__key", "__text").mapInArrow(work, "part int, kind int, body binary")


def heavy_anchors(keyed: DataFrame, n_docs: int) -> np.ndarray:
    """Sorted anchor hashes that HEAVY_COUNT or more of about HEAVY_DOCS documents hold.

    The sample only decides how work is split; results don't depend on it. At most
    (runs of the sample) / HEAVY_COUNT hashes come to the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in slices(batch.column(0), HASH_BYTES):
                doc, _, _, _, h = anchors.runs(data, at)
                order = np.lexsort((doc, h))
                once = order[_firsts([h, doc], order)]
                u, c = np.unique(h[once], return_counts=True)
                more = c > 1
                yield pa.RecordBatch.from_arrays([pa.array(u[more].view(np.int64)), pa.array(c[more])], names=["h", "c"])

    share = max(1, n_docs // HEAVY_DOCS)
    some = keyed.filter(F.pmod(F.xxhash64("__key"), F.lit(share)) == 0).select("__text")
    got = some.mapInArrow(work, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= HEAVY_COUNT).select("h")
    return np.sort(np.array([r["h"] for r in got.collect()], dtype=np.int64).view(np.uint64))


def shared_runs(blocks: DataFrame, parts: int) -> DataFrame:
    """(edge, key, lo, n, off): settled repeats (edge false), and runs or windows whose hash others have (edge true)."""

    def work(table: pa.Table) -> pa.Table:
        kinds, bodies = table.column("kind").to_pylist(), [x.as_py() for x in table.column("body")]
        get = lambda k, t: np.concatenate([np.frombuffer(b, t) for b, x in zip(bodies, kinds) if x == k] or [np.empty(0, t)])
        run, win, done = _several(get(0, _RUN)), _several(get(1, _WIN)), get(2, _DONE)
        return pa.table(
            {
                "edge": np.arange(len(done) + len(run) + len(win)) >= len(done),
                "key": np.concatenate([done["key"], run["key"], win["key"]]),
                "lo": np.concatenate([done["lo"], run["lo"], win["lo"]]).astype(np.int64),
                "n": np.concatenate([done["n"], run["n"], np.ones(len(win))]).astype(np.int32),
                "off": np.concatenate([np.zeros(len(done)), run["off"], np.full(len(win), WINDOWED)]).astype(np.int32),
            }
        )

    return blocks.repartition(parts, "part").groupBy("part").applyInArrow(work, "edge boolean, key long, lo long, n int, off int")


def _several(rows: np.ndarray) -> np.ndarray:
    """The rows whose hash is not theirs alone."""
    _, inverse, count = np.unique(rows["h"], return_inverse=True, return_counts=True)
    return rows[count[inverse] > 1]


def edge_blocks(texts: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """(part, body) blocks of edge runs with their bytes. texts: __key, __row.

    Anchor hashes are taken from the bytes again; they needn't travel to the texts.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *_ in slices(text_of(batch.column(1)), SLICE_BYTES):
                some = batch.slice(i, j - i).filter(batch.column(2).slice(i, j - i).is_valid())
                if not some.num_rows:
                    continue
                (data, at), lists = flat(text_of(some.column(1))), some.column(2)
                keys, rows = some.column(0).to_numpy(zero_copy_only=False), lists.flatten()
                doc = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
                ctx = np.empty(len(rows), _RUN)
                ctx["key"] = keys[doc]
                for name in ("lo", "n", "off"):
                    ctx[name] = rows.field(name).to_numpy(zero_copy_only=False)
                place = at[doc] + ctx["lo"].astype(np.int64)
                ctx["h"] = edge_hashes(data, place, ctx["off"])
                part = (anchors.mixed(np.ascontiguousarray(ctx["h"])) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ctx, part, place = ctx[order], part[order], place[order]
                size = ctx["n"].astype(np.int64) + WINDOW - 1
                pos, _ = _explode(place, size)
                body, length = data[pos], np.concatenate([[0], np.cumsum(size)])
                head = np.flatnonzero(_firsts([part], np.arange(len(part))))
                ends = np.append(head[1:], len(part))
                out = [sealed(ctx[a:z].tobytes() + body[length[a] : length[z]].tobytes(), z - a) for a, z in zip(head, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(part[head], pa.int32()), pa.array(out, pa.binary())], names=["part", "body"])

    per_doc = edges.groupBy(F.col("key").alias("__k")).agg(F.collect_list(F.struct("lo", "n", "off")).alias("e"))
    # a left join as in the last step, so that both share one exchange of the texts
    joined = texts.join(per_doc, F.col("__key") == F.col("__k"), "left").select("__key", "__row", "e")
    return joined.mapInArrow(work, "part int, body binary")


def sealed(body: bytes, n: int) -> bytes:
    """A block of n runs, packed: its passages are most of what this operator shuffles."""
    return np.array([n, len(body)], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unsealed(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a block and their bytes."""
    n, size = np.frombuffer(block, np.int64, 2).tolist()
    body = pa.decompress(block[16:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.frombuffer(body, _RUN, n), np.frombuffer(body, np.uint8, offset=n * _RUN.itemsize)


def text_of(rows: pa.StructArray) -> pa.Array:
    """The texts of `__row` structs; whole rows go to both joins, so that they are shuffled once."""
    return pc.struct_field(rows, "text")


def edge_hashes(data: np.ndarray, place: np.ndarray, off: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Anchor hashes of runs (first window, anchor offset), and the own hashes of single windows."""
    grams = anchors.gram_hashes(data)
    single = np.flatnonzero(off == WINDOWED)
    out = grams[np.where(off == WINDOWED, place, place + off)]
    if len(single):
        s, span = Suffixes(data), np.arange(WINDOW - anchors.GRAM + 1)
        for k in range(0, len(single), step):
            w = place[single[k : k + step]]
            out[single[k : k + step]] = window_hash(s, w, grams[w[:, None] + span].min(axis=1))
    return out


class Suffixes:
    """Suffixes of a byte string, compared on their first bytes by prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix, self.powers = anchors.prefix_hash(data)

    def span(self, i: np.ndarray, n) -> np.ndarray:
        return anchors.span_hash(self.prefix, self.powers, i, i + n)

    def common(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Length of the common extension, n at most, by binary search."""
        if len(n) and n.max() > LONGEST:
            raise ValueError("prefix hashes modulo 2**64 tell apart short strings only")
        out = n.copy()
        diff = np.flatnonzero(self.span(x, n) != self.span(y, n))
        if len(diff):
            p, q = x[diff], y[diff]
            lo, hi = np.zeros(len(diff), np.int64), n[diff]
            while (hi - lo > 1).any():
                mid = (lo + hi) // 2
                same = self.span(p, mid) == self.span(q, mid)
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
            out[diff] = lo
        return out

    def less(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        k = self.common(x, y, n)
        whole = k >= n
        k = np.minimum(k, n - 1)
        return np.where(whole, or_equal, self.data[x + k] < self.data[y + k])

    def sort(self, start: np.ndarray, n: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes by (group, content): bottom-up mergesort of all groups at once.

        A suffix counts with its first n bytes; n is the same within a group.
        """
        order = np.argsort(group, kind="stable")
        head = np.flatnonzero(_firsts([group], order))
        size = np.diff(np.append(head, len(order)))
        base, end = np.repeat(head, size), np.repeat(head + size, size)
        width = 1
        while width < (size.max() if len(size) else 0):
            live = np.flatnonzero(end - base > width)
            b, e = base[live], end[live]
            k = (live - b) // width
            left = k % 2 == 0
            own = b + k * width
            lo = np.minimum(np.where(left, own + width, own - width), e)
            hi = np.minimum(np.where(left, own + 2 * width, own), e)
            first, x, length = np.where(left, own, own - width), start[order[live]], n[order[live]]
            a, z = lo.copy(), hi.copy()
            while len(todo := np.flatnonzero(a < z)):
                mid = (a[todo] + z[todo]) // 2
                before = self.less(start[order[mid]], x[todo], length[todo], ~left[todo])
                a[todo] = np.where(before, mid + 1, a[todo])
                z[todo] = np.where(before, z[todo], mid)
            target = first + (live - own) + (a - lo)
            moved = order.copy()
            moved[target] = order[live]
            order, width = moved, 2 * width
        return order

    def same_bytes(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, step: int = 1 << 21) -> np.ndarray:
        """Whether the first n bytes are equal, byte by byte."""
        out, total = np.zeros(len(x), dtype=bool), np.cumsum(n)
        i = 0
        while i < len(x):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + step)))
            (p, idx), (q, _) = _explode(x[i:j], n[i:j]), _explode(y[i:j], n[i:j])
            out[i:j] = np.bincount(idx[self.data[p] != self.data[q]], minlength=j - i) == 0
            i = j
        return out

    def repeats(self, start: np.ndarray, n: np.ndarray, group: np.ndarray, key: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Which suffixes equal one of their group that is earlier by (key, lo).

        The sort brings equal suffixes together; neighbours are verified by their bytes.
        """
        again = np.zeros(len(start), dtype=bool)
        by = np.argsort(group, kind="stable")
        new = _firsts([group], by)
        some = by[~(new & np.append(new[1:], True))]  # what is alone in its group repeats nothing
        if not len(some):
            return again
        order = some[self.sort(start[some], n[some], group[some])]
        o, m, g = start[order], n[order], group[order]
        near = np.flatnonzero(g[1:] == g[:-1])
        near = near[self.common(o[near + 1], o[near], m[near]) >= m[near]]
        joined = np.zeros(len(order), dtype=bool)
        joined[near[self.same_bytes(o[near + 1], o[near], m[near])] + 1] = True
        content = np.cumsum(~joined)
        best = np.lexsort((lo[order], key[order], content))
        again[order[best]] = ~_firsts([content], best)
        return again


#: The offset that marks single windows of heavy anchors among the edges.
WINDOWED = 255


def sort_edges(bodies: list[bytes]) -> np.ndarray:
    """Ranges of windows (key, lo, n) that equal an earlier window, among the runs of some anchors.

    Whole runs are sorted first, so that copies are sorted once; then all windows of the
    first run of each content, where an anchor has several contents.
    """
    ctx, texts = zip(*map(unsealed, bodies))
    c, s = np.concatenate(ctx), Suffixes(np.concatenate(texts))
    n, key, lo, off = c["n"].astype(np.int64), c["key"], c["lo"].astype(np.int64), c["off"].astype(np.int64)
    start, h = np.concatenate([[0], np.cumsum(n + WINDOW - 1)])[:-1], np.ascontiguousarray(c["h"])
    again = s.repeats(start, n + WINDOW - 1, alike(h, off, n), key, lo)
    out = [_spans(key[again], lo[again], n[again])]
    first = np.flatnonzero(~again & (off != WINDOWED))
    w, idx = _explode(start[first], n[first])
    run = first[idx]
    shift = w - start[run]
    with np.errstate(over="ignore"):
        group = anchors.mixed(h[run] + (off[run] - shift).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = s.repeats(w, np.full(len(w), WINDOW, np.int64), group, key[run], lo[run] + shift)
    out.append(_spans(key[run][again], (lo[run] + shift)[again], np.ones(int(again.sum()), np.int64)))
    return np.concatenate(out)


def settle_edges(blocks: DataFrame, parts: int) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        out = sort_edges([x.as_py() for x in table.column("body")])
        return pa.table({"key": out["key"].copy(), "lo": out["lo"].astype(np.int64), "n": out["n"].astype(np.int32)})

    return blocks.repartition(parts, "part").groupBy("part").applyInArrow(work, "key long, lo long, n int")


def cut(text: bytes, lo: np.ndarray, n: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside of all windows, and the number of maximal removed runs."""
    if not len(lo):
        return text, 0
    order = np.argsort(lo, kind="stable")
    a, b = lo[order], np.maximum.accumulate(lo[order] + n[order] + WINDOW - 1)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    head = np.flatnonzero(new)
    starts, ends = a[head].tolist(), b[np.append(head[1:], len(a)) - 1].tolist()
    kept, at = [], 0
    for i, j in zip(starts, ends):
        kept.append(text[at:i])
        at = j
    kept.append(text[at:])
    return b"".join(kept), len(starts)


def remove_repeats(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """`__row` (all columns of docs) with n_bytes, n_removed, n_spans and kept.

    kept is binary; with as_text a string without the bytes of characters cut in two.
    """
    spark = docs.sparkSession
    keyed = with_row_key(docs, "doc_id")
    texts_only = keyed.select("__key", F.col("__row.text").alias("__text"))
    size = texts_only.agg(F.count("*").alias("n"), F.sum(F.octet_length("__text")).alias("b")).first()
    n_bytes = size["b"] or 0
    parts = max(8, int(n_bytes / 32 / PART_RUNS) + 1)
    heavy = heavy_anchors(texts_only, size["n"])
    found = materialize(shared_runs(run_blocks(texts_only, parts, heavy), parts), "runs")
    release_shuffles(spark)
    edges = found.filter("edge").select("key", "lo", "n", "off")
    edge_parts = max(8, int(edges.count() * 140 / PART_BYTES) + 1)
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes / (64 << 20)) + 1)
    texts = keyed.repartition(deal, "__key")
    sorted_out = settle_edges(edge_blocks(texts, edges, edge_parts), edge_parts)
    ranges = found.filter("not edge").select("key", "lo", "n").union(sorted_out)
    per_doc = ranges.repartition(deal, "key").groupBy(F.col("key").alias("__k")).agg(F.collect_list(F.struct("lo", "n")).alias("r"))
    whole = texts.join(per_doc, F.col("__key") == F.col("__k"), "left").select("__key", "__row", "r")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, kind = np.zeros(0, np.int64), pa.string() if as_text else pa.binary()
        for batch in batches:
            for i, j, data, at in slices(text_of(batch.column(1))):
                raw, lists = data.tobytes(), batch.column(2).slice(i, j - i)
                off, rows, valid = lists.offsets.to_numpy(), lists.values, lists.is_valid().to_numpy(zero_copy_only=False)
                lo, n = (rows.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "n"))
                kept, gone, spans = [], [], []
                for k in range(j - i):
                    mine = slice(off[k], off[k + 1])
                    rest, count = cut(raw[at[k] : at[k + 1]], lo[mine] if valid[k] else none, n[mine] if valid[k] else none)
                    kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                    gone.append(int(at[k + 1] - at[k]) - len(rest))
                    spans.append(count)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, kind)],
                    names=["__row", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    row = keyed.schema["__row"].dataType.simpleString()
    return whole.mapInArrow(work, f"__row {row}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def brute_force(texts: list[bytes]) -> list[tuple[bytes, int, int]]:
    """(kept, removed, spans) by a dictionary of all windows; for small tests."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - WINDOW + 1):
            w = t[i : i + WINDOW]
            if w in seen:
                gone[i : i + WINDOW] = b"\x01" * WINDOW
            seen.add(w)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(gone), spans))
    return out

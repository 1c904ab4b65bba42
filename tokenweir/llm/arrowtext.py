"""Text columns of Arrow batches as flat byte arrays, cut into slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes."""
    data, at = flat(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[at[1:]] - total[at[:-1]]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def word_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True where a word `[^\\x20\\x09-\\x0D]+` starts; words end with their document."""
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    start[first] = word[first]
    return start


def gram_valid(n_bytes: int, at: np.ndarray, n: int) -> np.ndarray:
    """True at positions whose n bytes lie in one document."""
    ok = np.ones(n_bytes, dtype=bool)
    for k in range(1, n):
        ends = at[1:] - k
        ok[ends[ends >= at[:-1]]] = False
    return ok

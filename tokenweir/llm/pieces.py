"""SentencePiece encoding and decoding by a shared-prefix forward pass over sorted words.

A text is marked (`▁` for spaces, one in front) and cut before each run of marks, where
no piece can cross. The distinct marked words of a batch are sorted, which is the
depth-first order of their trie; forward states of the prefix that a word shares with the
one before are kept, only the rest is computed.

The state of a prefix depends on the model file. For unigram models it is the best score
and its last piece (Viterbi). For BPE models the segmentation of every prefix is unique:
its last piece is the one that is compatible with the last piece of what stands before,
that is, encoding the two pieces' text by merges gives just the two. The result equals
that of merging by rank, and is had left to right, so it can be shared between words with
a common prefix; a plain score maximum would not equal the model's own segmentation.

Defined cases: null or empty text has no ids and decodes to the empty text; characters
outside of the vocabulary become byte pieces (or the unknown id where the model has no
bytes); a text that holds the mark itself decodes with a space in its place; a very long
text is a slice of its own and is encoded whole; of paths with equal scores the one whose
last piece begins first wins; repeated rows are encoded each; an empty table gives no rows;
other columns pass through `encode_documents` as asked.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenweir.llm.arrowtext import SLICE_BYTES, slices

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words, their characters and pairs that a worker remembers; on overflow it forgets all, results are the same.
CACHE_WORDS = 400_000
CACHE_CHARS = 8_000_000
CACHE_PAIRS = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: ints, raw 4 or 8 bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class PieceModel:
    """Pieces, scores and kinds of a model file, with encoder and decoder."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.bpe, self.prefix = False, True
        for field, value in _fields(data):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append(part.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                kinds.append(part.get(3, 1))
            elif field == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models without character maps and whitespace removal are supported")
                self.prefix = bool(spec.get(3, 1))
        if 4 in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        self.unknown = kinds.index(2)
        self.bytes_ = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == 6}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 1}
        self.text = [
            bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(MARK, " ").encode()
            for p, k in zip(self.pieces, kinds)
        ]
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that cross word marks are not supported")
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        self.cut = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.lowest = min(self.scores[i] for i in self.ids.values()) - 10
        self.words: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.live: set[str] | dict[str, int] = self.ids
        if self.bpe:
            self.live = {p for p in self.ids if self.merge(p) == [p]}
        self.id_pairs: dict[int, bool] = {}
        self.ends: dict = {}
        for p in self.live:
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = self.ids[p]

    def merge(self, word: str) -> list[str]:
        """The word's pieces by merging neighbours, best score first, leftmost of equals."""
        parts, ids, scores = list(word), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of sorted distinct words, each sharing the states of its common prefix."""
        out: dict[str, tuple[int, ...]] = {}
        before = ""
        start: list[int] = [0]  # where the last piece of each prefix begins
        score: list[float] = [0.0]
        last: list[int] = [-1]
        if len(self.id_pairs) > CACHE_PAIRS:
            self.id_pairs.clear()
        for word in words:
            n = min(len(word), len(before))
            keep = 0
            while keep < n and word[keep] == before[keep]:
                keep += 1
            del start[keep + 1 :], score[keep + 1 :], last[keep + 1 :]
            if self.bpe:
                self._extend_merged(word, start, last)
            else:
                self._extend_scored(word, start, score)
            before, pieces, at = word, [], len(word)
            while at:
                pieces.append(word[start[at] : at])
                at = start[at]
            ids: list[int] = []
            for p in reversed(pieces):
                k = self.ids.get(p)
                if k is not None:
                    ids.append(k)
                elif self.bytes_:
                    ids.extend(self.bytes_[b] for b in p.encode())
                else:
                    ids.append(self.unknown)
            out[word] = tuple(ids)
        return out

    def _extend_merged(self, word: str, start: list[int], last: list[int]) -> None:
        """States of the prefixes beyond those held: where the last piece begins, and its id (-1: unknown).

        Candidates come from a trie of reversed pieces, walked back from the prefix's end.
        """
        root, pairs, n = self.ends, self.id_pairs, len(self.pieces)
        for i in range(len(start), len(word) + 1):
            node, j = root, i
            while j:
                j -= 1
                node = node.get(word[j])
                if node is None:
                    start.append(i - 1)
                    last.append(-1)
                    break
                t = node.get("")
                if t is not None:
                    if j:
                        p = last[j]
                        ok = pairs.get(p * n + t) if p >= 0 else None
                        if ok is None:
                            ok = self.compatible(word[start[j] : j], word[j:i])
                            if p >= 0:
                                pairs[p * n + t] = ok
                        if not ok:
                            continue
                    start.append(j)
                    last.append(t)
                    break
            else:
                start.append(i - 1)
                last.append(-1)

    def _extend_scored(self, word: str, start: list[int], score: list[float]) -> None:
        for i in range(len(start), len(word) + 1):
            best, at = None, i - 1
            for j in range(max(0, i - self.longest), i):
                k = self.ids.get(word[j:i])
                s = score[j] + (self.scores[k] if k is not None else self.lowest) if k is not None or i - j == 1 else None
                if s is not None and (best is None or s > best):
                    best, at = s, j
            start.append(at)
            score.append(best)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        cut, words = self.cut.findall, self.words
        units = [cut((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*units) - words.keys() if units else set()
        more = sum(map(len, new))
        if len(words) + len(new) > CACHE_WORDS or self.held + more > CACHE_CHARS:
            words.clear()
            new = set().union(*units)
            self.held, more = 0, sum(map(len, new))
        self.held += more
        words.update(self.learn(sorted(new)))
        out = []
        for us in units:
            ids: list[int] = []
            for u in us:
                ids.extend(words[u])
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.text.__getitem__, ids))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


#: Models that a worker has parsed, by the SHA-256 of their file.
_MODELS: dict[bytes, PieceModel] = {}


def encode_documents(docs: DataFrame, model_path: str = DEFAULT_MODEL, columns: list[str] | None = None) -> DataFrame:
    """`columns` of docs (default: doc_id) with n_pieces, piece_ids and round_trip.

    round_trip says whether decoding the ids gives the text again (marks count as spaces).
    """
    spark: SparkSession = docs.sparkSession
    with open(model_path, "rb") as f:  # the driver reads the file, executors get its bytes
        shared = spark.sparkContext.broadcast(f.read())
    key = hashlib.sha256(shared.value).digest()
    names = ["n_pieces", "piece_ids", "round_trip"]
    columns = [c for c in (columns or ["doc_id"]) if c not in names]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(key) or _MODELS.setdefault(key, PieceModel(shared.value))
        for batch in batches:
            for i, j, data, at in slices(batch.column(len(columns)), SLICE_BYTES):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                ids = model.encode_all(texts)
                same = [model.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts)]
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                flat = np.fromiter((k for x in ids for k in x), dtype=np.int32, count=int(sizes.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in range(len(columns))), pa.array(sizes), lists, pa.array(same)], names=[*columns, *names]
                )

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "n_pieces long", "piece_ids array<int>", "round_trip boolean"])
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("__text")).mapInArrow(work, schema)

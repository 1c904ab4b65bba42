"""Words, token estimates and line helpers for algorithms that run inside Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import regex
import xxhash

WORD = regex.compile(r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*")
_UNIT = regex.compile(r"[\p{L}\p{N}]{1,4}|(?<=\s)\s{1,4}|[^\p{L}\p{N}\s]")
# Function words left out of content words.
STOPWORDS = {
    "en": "a an and are as at be but by for from has have in is it its of on or that the this to was were will with what which who how",
    "de": "das dem den der des die ein eine einer für ist im in mit nicht oder sich sie sind und von wie zu",
    "fr": "au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui sur un une",
    "es": "a al con de del el en es la las lo los no o para por que se su un una y",
}
_STOPS = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def language(text: str, chars: int | None = 8192) -> str:
    """The language whose function words are most frequent in the first `chars` characters (None: in all); English if none."""
    ws = words(text[:chars])
    votes = {k: sum(w in v for w in ws) for k, v in _STOPS.items()}
    return max(votes, key=lambda k: (votes[k], k == "en"))


def content_words(text: str, lang: str | None = None) -> list[str]:
    stops = _STOPS[lang or language(text)]
    return [p for w in words(text) for p in w.split("_") if len(p.encode()) >= 2 and p not in stops]


def estimate(text: str) -> int:
    return math.floor(len(_UNIT.findall(text)) * 0.72 + 0.5)


def lines(text: str) -> list[str]:
    if not text:
        return []
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def simhash(text: str) -> int:
    """64 sign bits of the summed hashes of a text's words; 0 without words."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 1) for w in words(text)]
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").tobytes(), "little")

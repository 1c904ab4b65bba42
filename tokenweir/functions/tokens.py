"""Token counts: a heuristic in one regular expression, and exact byte-pair counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

SPACE = r"\x09-\x0D\x85\p{Z}"
LETTER = r"\p{L}\p{N}"
#: Letter runs cost a token per started four letters, other signs one each, and blanks
#: after the first of a run one per started four: each is one match.
_UNIT = rf"[{LETTER}]{{1,4}}|(?<=[{SPACE}])[{SPACE}]{{1,4}}|[^{LETTER}{SPACE}]"
SCALE = 0.72


def estimate(text: Column) -> Column:
    """Estimated tokens of a text; null counts 0."""
    return F.floor(F.coalesce(F.regexp_count(text, F.lit(_UNIT)), F.lit(0)) * SCALE + 0.5).cast("long")


def counter_label(provider: Column, vocabulary: str | None = None) -> Column:
    """Which counter stands behind a count: for openai the given vocabulary, else approximate."""
    exact = F.lit(vocabulary) if vocabulary else F.lit("o200k-approx")
    return F.when(provider == "openai", exact).otherwise(F.concat(F.lit("approx("), provider, F.lit(")")))


def bpe_counter(ranks_path: str, pattern: str | None = None):
    """A text column's exact byte-pair count with the merge ranks of a tiktoken file (Arrow)."""

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(ranks_path, pattern)
        for texts in batches:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int64")

    return count


def byte_pairs(ranks_path: str, pattern: str | None = None):
    """A plain function that counts the byte pairs of a text exactly."""
    encoding = load_encoding(ranks_path, pattern)
    return lambda text: len(encoding.encode_ordinary(text))


_ENCODINGS: dict = {}
#: Splits words as byte-pair vocabularies expect: contractions, words, numbers, signs, blanks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(ranks_path: str, pattern: str | None = None):
    import base64

    import tiktoken

    key = (ranks_path, pattern)
    if key not in _ENCODINGS:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        _ENCODINGS[key] = tiktoken.Encoding("table", pat_str=pattern or PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]

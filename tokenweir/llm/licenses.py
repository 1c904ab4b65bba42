"""License scans, in DataFrame expressions only.

Base labels: places where a phrase's words stand consecutively. Further labels come from
an exact set-similarity join of text blocks with notice templates. Blocks are the lines,
and for notices wrapped over lines all runs of as many words of the text as the template
has, whatever line ends stand between them. The tokens of all templates are ordered by
their frequency in the whole corpus, rarest first. An index leads from the tokens of the
templates' prefixes to the templates that a text can hold at all (prefix filter); enough
of a template's tokens have to stand in the text and then in the block (length filter),
enough of them after the first common one on both sides (positional filter). What is left
is verified.

Templates travel as literals, GROUP_TEMPLATES at a time; more of them are more columns of
the same scan, with the same results. The blocks never leave their row, so no key can be
hot and nothing is shuffled.

Defined cases: null text is empty (no words, null first_word and last_word, empty labels,
score 0); a very long text is scanned whole, in its row; of equal scores the largest is
one and the same; a block just at the threshold matches; repeated rows and ids give a row
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Phrases and their labels, as the result contract states them.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Short license notices and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
]
#: Templates that are compared in one column.
GROUP_TEMPLATES = 500
#: Word characters of text that still has capitals, inside a Java class.
W = r"0-9A-Za-z\x{80}-\x{10FFFF}"


def phrase_pattern(phrase: str) -> str:
    return rf"(?i)(?<![{W}])" + rf"[^{W}]+".join(phrase.split()) + rf"(?![{W}])"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{W}]+")).cast("long")


def lowered_words(text: Column) -> Column:
    """Words with A-Z lower-cased and all other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(f"[{W}]+"), F.lit(0))


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def word_tables(docs: DataFrame, groups: list[list[str]]) -> DataFrame:
    """doc_id, t (text or ''), n_words, pw (words of PHRASES in the text), v0, v1 ...: tokens of each group in the text, in its order."""
    t = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", t.alias("t"), lowered_words(t).alias("ws"))
    phrase_words = sorted({w for p in PHRASES for w in p.split()})
    return words.select(
        "doc_id",
        "t",
        F.size("ws").cast("long").alias("n_words"),
        F.array_intersect("ws", strings(phrase_words)).alias("pw"),
        *[F.array_intersect(strings(order), F.array_intersect("ws", strings(order))).alias(f"v{k}") for k, order in enumerate(groups)],
    )


def base_places(df: DataFrame) -> DataFrame:
    """`df` (t, pw) with n_base, first_word, last_word and base (label array); only texts with all words of a phrase are searched."""
    counts = []
    for phrase in PHRASES:
        own = sorted(set(phrase.split()))
        counts.append(F.when(F.size(F.array_intersect("pw", strings(own))) == len(own), F.regexp_count("t", F.lit(phrase_pattern(phrase)))).otherwise(F.lit(0)))
    df = df.withColumns({f"n{i}": c for i, c in enumerate(counts)})
    start, last = [], []
    for i, phrase in enumerate(PHRASES):
        before = lambda more, p=phrase: n_words(F.regexp_extract("t", f"(?s)^(.*{more})" + phrase_pattern(p), 1))
        start.append(F.when(F.col(f"n{i}") > 0, before("?")))
        last.append(F.when(F.col(f"n{i}") > 0, before("")))
    return df.withColumns(
        {
            "n_base": sum(F.col(f"n{i}") for i in range(len(PHRASES))).cast("long"),
            "first_word": F.array_min(F.array(*start)),
            "last_word": F.array_max(F.array(*last)),
            "base": F.array_compact(F.array(*[F.when(F.col(f"n{i}") > 0, F.lit(v)) for i, v in enumerate(PHRASES.values())])),
        }
    )


def token_order(docs: DataFrame, templates) -> list[str]:
    """The template vocabulary by document frequency in all of `docs`, rarest first.

    Only counts of the templates' own tokens come to the driver: their number is bounded
    by the templates.
    """
    vocab = sorted({w for text, _ in templates for w in text.split()})
    words = F.array_intersect(lowered_words(F.coalesce(F.col("text"), F.lit(""))), F.array(*map(F.lit, vocab)))
    counts = dict.fromkeys(vocab, 0)
    for r in docs.select(F.explode(words).alias("w")).groupBy("w").count().collect():
        counts[r["w"]] = r["count"]
    return sorted(vocab, key=lambda w: (counts[w], w))


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def candidates(held: Column, templates, order: list[str], threshold: float) -> Column:
    """The templates that a text can hold, as structs; held: the text's tokens in global order, rarest first."""
    rank = {w: i for i, w in enumerate(order)}
    index: dict[str, list[Column]] = {}
    for text, label in templates:
        own = sorted(set(text.split()), key=rank.__getitem__)
        need = needed(len(own), threshold)
        prefix = own[: len(own) - need + 1]
        entry = F.struct(
            strings(own).alias("s"), strings(prefix).alias("prefix"), F.lit(need).alias("need"),
            F.lit(len(text.split())).alias("n"), F.lit(label).alias("label"),
        )
        for w in prefix:
            index.setdefault(w, []).append(entry)
    table = F.map_from_arrays(strings(index), F.array(*[F.array(*v) for v in index.values()]))
    found = F.flatten(F.transform(F.array_intersect(held, strings(index)), lambda w: F.element_at(table, w)))
    return F.filter(F.array_distinct(found), lambda c: F.size(F.array_intersect(held, c["s"])) >= c["need"])


MATCHES = "array<struct<label:string,containment:double>>"


def line_matches(text: Column, live: Column, held: Column) -> Column:
    """MATCHES: one element per line and candidate template that match."""
    lines = F.transform(F.split(text, "\n"), lambda b: F.array_intersect(held, lowered_words(b)))

    def positional(b: Column, c: Column) -> Column:
        first = F.element_at(F.array_intersect(b, c["prefix"]), 1)
        rest = F.least(F.size(b) - F.array_position(b, first).cast("int"), F.size(c["s"]) - F.array_position(c["s"], first).cast("int"))
        return rest + 1 >= c["need"]

    def matches(b: Column) -> Column:
        able = F.filter(live, lambda c: (F.size(b) >= c["need"]) & F.arrays_overlap(b, c["prefix"]))
        able = F.filter(able, lambda c: positional(b, c))
        common = F.transform(able, lambda c: F.struct(c.alias("c"), F.size(F.array_intersect(b, c["s"])).alias("k")))
        return F.transform(F.filter(common, lambda m: m["k"] >= m["c"]["need"]), lambda m: matched(m["c"], m["k"]))

    return F.flatten(F.transform(lines, matches))


def matched(c: Column, common: Column) -> Column:
    return F.struct(c["label"].alias("label"), (common.cast("double") / F.size(c["s"])).alias("containment"))


def window_matches(places: Column, live: Column) -> Column:
    """MATCHES: the best window of each candidate template whose windows match; places: (w, p) of template tokens."""

    def best(own: Column, c: Column) -> Column:
        at = lambda j: F.element_at(own, j)["p"]
        # a window that starts at a token and reaches the need-th one after it
        starts = F.filter(F.sequence(F.lit(1), F.size(own) - c["need"] + 1), lambda j: at(j + c["need"] - 1) - at(j) < c["n"])
        inside = lambda j: F.filter(F.slice(own, j, c["n"]), lambda x: x["p"] - at(j) < c["n"])
        return F.array_max(F.transform(starts, lambda j: F.size(F.array_distinct(F.transform(inside(j), lambda x: x["w"])))))

    own = F.transform(live, lambda c: F.struct(c.alias("c"), F.filter(places, lambda x: F.array_contains(c["s"], x["w"])).alias("own")))
    scored = F.transform(
        F.filter(own, lambda m: F.size(m["own"]) >= m["c"]["need"]),
        lambda m: F.struct(m["c"].alias("c"), best(m["own"], m["c"]).alias("k")),
    )
    return F.transform(F.filter(scored, lambda m: m["k"] >= m["c"]["need"]), lambda m: matched(m["c"], m["k"]))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    groups = [templates[i : i + GROUP_TEMPLATES] for i in range(0, len(templates), GROUP_TEMPLATES)]
    order = token_order(docs, templates)
    orders = [[w for w in order if w in vocab] for vocab in ({w for t, _ in g for w in t.split()} for g in groups)]
    df = base_places(word_tables(docs, orders))
    none, t = F.array().cast(MATCHES), F.col("t")
    for k, (g, own) in enumerate(zip(groups, orders)):
        df = df.withColumn(f"live{k}", candidates(F.col(f"v{k}"), g, own, threshold))
    # lines and places are taken apart again only in the few texts that some template may match
    for k, own in enumerate(orders):
        live, held = F.col(f"live{k}"), F.col(f"v{k}")
        hits = F.filter(F.transform(lowered_words(t), lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda x: F.array_contains(held, x["w"]))
        both = F.concat(line_matches(t, live, held), F.when(F.contains(t, F.lit("\n")), F.flatten(F.transform(F.array(hits), lambda h: window_matches(h, live)))).otherwise(none))
        df = df.withColumn(f"m{k}", F.when(F.size(live) > 0, both).otherwise(none))
    m = F.concat(*[F.col(f"m{k}") for k in range(len(groups))]) if groups else none
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return df.withColumn("m", m).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.transform("m", lambda x: x["label"]))).alias("labels"),
        F.greatest(
            F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
            F.coalesce(F.array_max(F.transform("m", lambda x: x["containment"])), F.lit(0.0)),
        ).alias("score"),
    )

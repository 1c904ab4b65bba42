"""Mixing sources to target weights, in DataFrame expressions only.

Tokens are summed per source, a water-filling step turns weights into targets that no
source exceeds by more than `cap` repetitions, and each document is emitted floor(rate)
times plus one copy with probability equal to the fraction. The coin is an MD5 digest of
seed and document id, so every rerun and every partitioning gives the same mix.

Sources are ranked by windows over one row per source, in one task: thousands or millions
of sources are meant, not one per document.

Defined cases: null text has size 0 and follows its source, a very long text counts whole;
a null source is a source of its own and ranks last; sources with equal ratios are capped
in the order of their names; rows that repeat a doc_id share one coin; an empty table gives
an empty mix; columns beside the named ones pass through, and a column named like one of
the results stays inside `mix` (which adds none) and is ignored by `mix_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Source rows up to this many are broadcast; more go through an ordinary join.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source: source, source_size, target. `sizes` has source and size.

    Sorted by cap/weight, the capped sources come first: the level is that of the first
    source whose cap is not below the share it would get, all before it being capped.
    """
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source",
        "source_size",
        F.element_at(
            F.array(*[F.lit(w) for w in weights]),
            ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"),
        ).alias("w"),
    )
    order = [F.col("ratio"), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    t = ranked.withColumn("ratio", (F.lit(cap) * F.col("source_size")).cast("double") / F.col("w"))
    t = t.withColumns(
        {
            "left": F.sum("source_size").over(whole)
            - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0)),
            "w_left": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)),
            "at": F.row_number().over(W.orderBy(*order)),
        }
    ).withColumn("level", F.col("left").cast("double") / F.col("w_left"))
    t = t.withColumn(
        "level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("at", "level"))).over(whole)["level"]
    )
    return t.select(
        "source",
        "source_size",
        F.least((F.lit(cap) * F.col("source_size")).cast("double"), F.col("w") * F.col("level")).alias("target"),
    )


def coin(doc_id: Column, seed: str) -> Column:
    """A uniform double in [0, 1) from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _planned(docs: DataFrame, weights, cap: int, seed: str) -> DataFrame:
    """`__row` (all columns of docs), `__size`, `__source_size`, `__target`, `__copies`."""
    sizes = docs.select(F.col("source"), word_count(F.col("text")).alias("size"))
    targets = source_targets(sizes, weights, cap).select(
        F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")
    )
    few = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), word_count(F.col("text")).alias("__size")
    )
    side = F.broadcast(targets) if few else targets
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    return rows.join(side, F.col("__row.source").eqNullSafe(F.col("__s"))).withColumn(
        "__copies",
        (F.floor(rate) + (coin(F.col("__row.doc_id"), seed) < rate - F.floor(rate)).cast("long")).cast("long"),
    )


def mix_plan(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (0 where it is left out)."""
    return _planned(docs, weights, cap, seed).select(
        F.col("__row.doc_id").alias("doc_id"),
        F.col("__row.source").alias("source"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__copies").alias("copies"),
    )


def mix(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each document's row as many times as its plan says."""
    planned = _planned(docs, weights, cap, seed).filter("__copies > 0")
    return planned.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__n")).select(
        "__row.*"
    )

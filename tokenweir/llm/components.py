"""Connected components over an edge table, by alternating large-star and small-star steps.

Edges never leave the executors. Each round is two partial aggregates (the smallest
neighbour of each node) and two equi-joins; a node with very many neighbours is a hot key
only on the larger side of a join, which adaptive execution splits. Lineage is cut by a
written table in the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tokenweir.llm.common import drop_path, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each larger neighbour of u links to the smallest of u and its neighbours.
    Small star: each smaller neighbour of u, and u, link to the smallest of them."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("n")).select("u", F.least("u", "n").alias("m"))
    joined = both.join(least, F.col("a") == F.col("u"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b long): the smallest node reachable.

    Goes on until a round leaves the edges as they are; then each node links to its root.
    A round's table is deleted once the next is written. Null nodes and loops are ignored;
    no edges give no rows.
    """
    pairs = edges.filter("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
    now, path = written(pairs, "edges")
    state = None
    while True:
        after, new = written(_star(_star(now, True), False), "edges")
        drop_path(edges.sparkSession, path)
        now, path = after, new
        seen = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        if (seen["n"], seen["h"]) == state or not seen["n"]:
            break
        state = (seen["n"], seen["h"])
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return roots.union(own)

"""Lexical ranking over exploded terms: BM25+, feedback terms, fielded BM25, saturation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokenweir.functions import text as X

K1, B, DELTA = 1.2, 0.75, 1.0


def terms(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, tf, dl: term counts per chunk, from one exchange on the chunk and term."""
    ws = chunks.select(*keys, X.words(F.col("text")).alias("ws"))
    return ws.select(*keys, F.size("ws").alias("dl"), F.explode("ws").alias("term")).groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(chunks: DataFrame, group: str, chunk: str, query: DataFrame, k1: float = K1, b: float = B, delta: float = DELTA) -> DataFrame:
    """BM25+ score of every chunk against its group's query terms (query: group, term).

    A group's query travels to its chunks as an array, so that only hits are exploded;
    statistics per group are small aggregates.
    """
    asked = query.groupBy(group).agg(F.collect_set("term").alias("q"))
    ws = chunks.select(group, chunk, X.words(F.col("text")).alias("ws")).join(asked, group, "left")
    hit = ws.select(group, chunk, F.size("ws").alias("dl"), F.filter("ws", lambda w: F.array_contains("q", w)).alias("hit"))
    stats = hit.groupBy(group).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = hit.select(group, chunk, "dl", F.explode("hit").alias("term")).groupBy(group, chunk, "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy(group, "term").agg(F.count("*").alias("df"))
    s = hits.join(df, [group, "term"]).join(stats, group)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = s.groupBy(group, chunk).agg(F.sum(idf * (tf + delta)).alias("score"))
    return chunks.select(group, chunk).join(scored, [group, chunk], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def bm25_lines(docs: DataFrame, key: str, k1: float = K1, b: float = B, delta: float = DELTA) -> DataFrame:
    """key and `chunks`, the document's lines as (pos, score): BM25+ against the words of its first line.

    A document's lines stand in its row, and so do all statistics: nothing is shuffled, and
    the words are taken out of the text once.
    """
    words = F.transform(X.lines(F.col("text")), lambda x: X.words(x))

    def scored(ws: Column, q: Column, hits: Column, s: Column) -> Column:
        def score(found: Column, w: Column) -> Column:
            norm = k1 * (1 - b + b * F.size(w) / s["avgdl"])
            tf = lambda t: (F.size(w) - F.size(F.array_remove(w, t))).cast("double")
            idf = lambda t: F.element_at(s["idf"], F.array_position(q, t).cast("int"))
            return F.aggregate(found, F.lit(0.0), lambda z, t: z + idf(t) * (tf(t) * (k1 + 1) / (tf(t) + norm) + delta))

        return F.transform(hits, lambda h, i: F.struct(i.alias("pos"), score(h, F.get(ws, i)).alias("score")))

    def stats(ws: Column, q: Column, hits: Column) -> Column:
        n = F.size(ws).cast("double")
        df = lambda t: F.size(F.filter(hits, lambda h: F.array_contains(h, t)))
        idf = F.transform(F.transform(q, df), lambda c: F.log(1 + (n - c + 0.5) / (c + 0.5)))
        return F.struct(idf.alias("idf"), (F.aggregate(ws, F.lit(0).cast("long"), lambda z, w: z + F.size(w)) / n).alias("avgdl"))

    first = lambda ws: F.array_distinct(F.coalesce(F.get(ws, F.lit(0)), F.array().cast("array<string>")))
    chunks = X.let(words, lambda ws: X.let(first(ws), lambda q: X.let(
        F.transform(ws, lambda w: F.array_intersect(w, q)), lambda hits: X.let(stats(ws, q, hits), lambda s: scored(ws, q, hits, s)))))
    return docs.select(key, chunks.alias("chunks"))


def best_lines(scores: DataFrame, key: str, k: int, digits: int = 9) -> DataFrame:
    """key, pos, score, rank of the k best lines of each document, equal (rounded) scores by position."""
    order = F.array_sort(F.transform("chunks", lambda c: F.struct((-F.round(c["score"], digits)).alias("down"), c["pos"].alias("pos"))))
    best = scores.select(key, F.posexplode(F.slice(order, 1, k)).alias("at", "c"))
    return best.select(key, F.col("c.pos").alias("pos"), (-F.col("c.down")).alias("score"), (F.col("at") + 1).alias("rank"))


def ranked(scores: DataFrame, group: str, chunk: str, k: int) -> DataFrame:
    """The k best chunks of a group, equal scores by position."""
    r = F.row_number().over(W.partitionBy(group).orderBy(F.col("score").desc(), chunk))
    return scores.withColumn("rank", r).filter(F.col("rank") <= k)


def feedback_terms(chunks: DataFrame, scores: DataFrame, group: str, chunk: str, feedback: int = 4, n_terms: int = 10) -> DataFrame:
    """Expansion terms: by weight in the best chunks, each chunk's term shares weighted by its score."""
    best = ranked(scores.filter("score > 0"), group, chunk, feedback)
    total = F.sum("score").over(W.partitionBy(group))
    best = best.select(group, chunk, (F.col("score") / total).alias("share"))
    t = terms(chunks, [group, chunk]).join(best, [group, chunk])
    w = t.groupBy(group, "term").agg(F.round(F.sum(F.col("share") * F.col("tf") / F.col("dl")), 12).alias("weight"))
    r = F.row_number().over(W.partitionBy(group).orderBy(F.col("weight").desc(), "term"))
    return w.withColumn("rank", r).filter(F.col("rank") <= n_terms)


def bm25f(tools: DataFrame, query: list[str], weights={"name": 4.0, "params": 2.0, "description": 1.0}) -> DataFrame:
    """Fielded BM25 of tools (tool, name, params, description) against query words."""
    n = tools.agg(F.count("*").alias("n"))
    field = None
    for f, w in weights.items():
        ws = X.words(F.regexp_replace(F.coalesce(f, F.lit("")), "_", " "))
        part = tools.select("tool", F.lit(w).alias("w"), F.lit(f).alias("f"), F.size(ws).alias("len"), F.explode_outer(ws).alias("term"))
        field = part if field is None else field.unionAll(part)
    avg = field.select("tool", "f", "len").distinct().groupBy("f").agg(F.avg("len").alias("avg"))
    tf = field.filter(F.col("term").isin(query)).groupBy("tool", "f", "w", "len", "term").agg(F.count("*").alias("tf")).join(avg, "f")
    weighted = tf.groupBy("tool", "term").agg(F.sum(F.col("w") * F.col("tf") / (1 - B + B * F.col("len") / F.greatest("avg", F.lit(1e-9)))).alias("tfw"))
    df = weighted.groupBy("term").agg(F.count("*").alias("df"))
    s = weighted.join(df, "term").crossJoin(n)  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = s.groupBy("tool").agg(F.sum(idf * F.col("tfw") * (K1 + 1) / (K1 + F.col("tfw"))).alias("score"))
    return tools.select("tool").join(score, "tool", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def bigram_curve(items: DataFrame, group: str, pos: str) -> DataFrame:
    """Per item, how many distinct word pairs its group has shown up to it."""
    near = lambda ws: F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat(ws[i - 1], F.lit(" "), ws[i]))).otherwise(ws)
    pairs = X.let(X.words(F.col("text")), near)
    first = items.select(group, pos, F.explode(pairs).alias("p")).groupBy(group, "p").agg(F.min(pos).alias(pos))
    new = items.select(group, pos).join(first.groupBy(group, pos).agg(F.count("*").alias("new")), [group, pos], "left")
    w = W.partitionBy(group).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    return new.select(group, pos, F.sum(F.coalesce("new", F.lit(0))).over(w).cast("long").alias("seen"))


def knee(curve: DataFrame, group: str, pos: str, least: float = 0.05) -> DataFrame:
    """Where the curve bows most above its chord; null where it bows by `least` or less."""
    by = W.partitionBy(group)
    c = curve.withColumns({"i": F.row_number().over(by.orderBy(pos)) - 1, "n": F.count("*").over(by), "total": F.max("seen").over(by)})
    bow = F.col("seen") / F.col("total") - F.col("i") / (F.col("n") - 1)
    c = c.filter("n >= 3 and total > 0").withColumn("bow", F.round(bow, 12))
    g = c.groupBy(group).agg(F.max("bow").alias("bow"), F.min_by("i", F.struct(-F.col("bow"), "i")).alias("at"))
    return g.select(group, F.when(F.col("bow") > least, F.col("at")).cast("long").alias("knee"))


def term_profile(items: DataFrame, group: str, pos: str, field: str) -> DataFrame:
    """Rows whose value is rare among the values of their group: a count in at most a twentieth of the rows."""
    counts = items.groupBy(group, field).agg(F.count("*").alias("c"))
    stats = counts.groupBy(group).agg(F.count("*").alias("values"), F.sum("c").alias("n"))
    most = F.least(F.greatest(F.col("n") / 10, F.lit(2)), F.lit(24))
    rare = counts.join(stats, group).filter((F.col("c") * 20 <= F.col("n")) & (F.col("values") >= 2) & (F.col("values") <= most))
    return items.join(rare.select(group, field), [group, field], "left_semi").select(group, pos, field)

"""Segments of requests in relational form: lines, dedup, folding, gates and reports.

Everything per segment needs the segment's lines together, so rows are dealt once by the
segment (or request) key; windows and aggregates on that key reuse the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokenweir.functions import text as X
from tokenweir.functions.tokens import estimate


def conversation_segments(conversations: DataFrame) -> DataFrame:
    """request_id, seg_ix, role, instruction, text: a segment per turn of a conversation."""
    return conversations.select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("seg_ix"),
        "role",
        F.col("role").isin("system", "developer").alias("instruction"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def exploded(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.select(*keys, F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))


def _joined(lines: DataFrame, keys: list[str], value: Column) -> DataFrame:
    packed = F.sort_array(F.collect_list(F.struct(F.col("pos"), value.alias("line"))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("text"))


def _counted(line: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(line, F.lit(" [×"), n.cast("string"), F.lit("]"))).otherwise(line)


def _run_starts(items: Column, differs) -> Column:
    """Places (from 1) where a run of items begins: the first, and those that differ from the one before."""
    places = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 1) | differs(F.element_at(items, F.greatest(i - 1, F.lit(1))), F.element_at(items, i)))


def _lengths(starts: Column, total: Column) -> Column:
    """(start, n) of runs that begin at `starts` among `total` items."""
    return F.transform(starts, lambda st, k: F.struct(st.alias("st"), (F.coalesce(F.get(starts, k + 1), total + 1) - st).alias("n")))


def dedup_exact(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Equal lines of a segment once, at their first place, with `[×n]`; blanks stay.

    A segment's lines stand in its row, so nothing is shuffled: the lines are sorted there
    with their places, and runs of equal ones are counted. Texts without a repeated line
    (distinct lines are as many) are left as they are.
    """
    ls = X.lines(F.col("text"))

    def folded(lines: Column) -> Column:
        own = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.when(F.trim(x) == "", i).otherwise(-1).alias("own"), i.alias("pos")))

        def runs(items: Column) -> Column:
            starts = _run_starts(items, lambda a, b: (a["line"] != b["line"]) | (a["own"] != b["own"]))
            at = lambda r: F.element_at(items, r["st"])
            return X.let(starts, lambda st: F.transform(_lengths(st, F.size(items)), lambda r: F.struct(at(r)["pos"].alias("pos"), _counted(at(r)["line"], r["n"]).alias("line"))))

        return F.array_join(F.transform(F.array_sort(X.let(F.array_sort(own), runs)), lambda x: x["line"]), "\n")

    worded = X.nonblank(F.col("__lines"))
    again = F.size(F.array_distinct(worded)) < F.size(worded)
    return segments.withColumn("__lines", ls).withColumn("text", F.when(again, folded(F.col("__lines"))).otherwise(F.col("text"))).drop("__lines")


def dedup_adjacent(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of equal neighbouring lines folded, every distinct line in its place; within the row."""

    def folded(lines: Column) -> Column:
        starts = _run_starts(lines, lambda a, b: (a != b) | (F.trim(b) == ""))
        runs = X.let(starts, lambda st: F.transform(_lengths(st, F.size(lines)), lambda r: _counted(F.element_at(lines, r["st"]), r["n"])))
        return F.array_join(runs, "\n")

    ls = segments.withColumn("__lines", X.lines(F.col("text")))
    return ls.withColumn("text", F.when(F.size("__lines") > 0, folded(F.col("__lines"))).otherwise(F.col("text"))).drop("__lines")


def template_fold(lines: DataFrame, keys: list[str], min_run: int = 3) -> DataFrame:
    """Runs of neighbouring lines with one template (lines: keys, pos, line), folded if shorter.

    A run becomes `template [×n: (values) (values) ...]`; sizes are compared in bytes.
    """
    w = W.partitionBy(*keys).orderBy("pos")
    t = lines.withColumn("tpl", X.template(F.col("line")))
    t = t.withColumn("new", F.coalesce(F.col("tpl") != F.lag("tpl").over(w), F.lit(True)).cast("int"))
    t = t.withColumn("island", F.sum("new").over(w))
    row = F.concat(F.lit("("), F.array_join(X.variables(F.col("line")), ","), F.lit(")"))
    g = t.groupBy(*keys, "island").agg(
        F.min("pos").alias("pos"), F.count("*").alias("n"), F.first("tpl").alias("tpl"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", row.alias("r")))), lambda x: x["r"]), " ").alias("rows"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("raw"),
    )
    short = F.concat("tpl", F.lit(" [×"), F.col("n").cast("string"), F.lit(": "), F.col("rows"), F.lit("]"))
    fold = (F.col("n") >= min_run) & F.contains("tpl", F.lit("{}")) & (F.octet_length(short) < F.octet_length("raw") + 1)
    return g.select(*keys, "pos", F.col("n").alias("run"), fold.alias("folded"), F.when(fold, short).otherwise(F.col("raw")).alias("text"))


def errors_only(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Failure lines and the indented lines under them (lines: keys, pos, line), flagged keep.

    A continuation is kept if the last line that is not a continuation is a failure line.
    """
    w = W.partitionBy(*keys).orderBy("pos")
    strong = F.rlike("line", F.lit(X.STRONG))
    cont = (F.col("line").startswith(" ") | F.col("line").startswith("\t")) & ~strong
    head = F.last(F.when(~cont, strong), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    held = F.last(F.when(~cont | strong, strong), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return lines.withColumn("keep", F.when(cont, F.coalesce(held, head, F.lit(False))).otherwise(strong))


def level_census(lines: DataFrame, keys: list[str]) -> DataFrame:
    p = X.priority(F.col("line"))
    return lines.groupBy(*keys).agg(F.count("*").alias("lines"), F.count_if(p >= 1.0).alias("errors"), F.count_if((p >= 0.6) & (p < 1.0)).alias("warnings"))


def elided(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of dropped lines (keep false) as one marker, unless the marker is not shorter."""
    w = W.partitionBy(*keys).orderBy("pos")
    t = lines.withColumn("new", F.coalesce(F.col("keep") != F.lag("keep").over(w), F.lit(True)).cast("int"))
    t = t.withColumn("island", F.sum("new").over(w))
    g = t.groupBy(*keys, "island").agg(
        F.min("pos").alias("pos"), F.first("keep").alias("keep"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("size"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("raw"),
    )
    mark = X.elision(F.col("n"))
    hide = ~F.col("keep") & (F.octet_length(mark) + 1 < F.col("size"))
    return g.select(*keys, "pos", "n", hide.alias("hidden"), F.when(hide, mark).otherwise(F.col("raw")).alias("text"))


def first_per_file(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Search hits with their file, and whether they are the first of it in the segment."""
    f = lines.withColumn("file", F.nullif(F.regexp_extract("line", r"^((?:[A-Za-z]:)?[^:\n]*):\d+:", 1), F.lit("")))
    rank = F.row_number().over(W.partitionBy(*keys, "file").orderBy("pos"))
    return f.withColumn("first", F.col("file").isNotNull() & (rank == 1))


def top_lines(lines: DataFrame, keys: list[str], k: int, head: int = 3, tail: int = 3) -> DataFrame:
    """Keeps the first and last lines, all failures, and the best of the rest up to k."""
    by = W.partitionBy(*keys)
    t = lines.withColumns({"score": X.priority(F.col("line")), "rn": F.row_number().over(by.orderBy("pos")), "n": F.count("*").over(by)})
    t = t.withColumn("forced", (F.col("rn") <= head) | (F.col("rn") > F.col("n") - tail) | (F.col("score") >= 1.0))
    rank = F.row_number().over(by.orderBy(F.col("forced").desc(), F.col("score").desc(), "pos"))
    return t.withColumn("keep", F.col("forced") | (rank <= k)).drop("rn", "n")


def gate(before: DataFrame, after: DataFrame, keys: list[str], request: str = "request_id") -> DataFrame:
    """Per request, the stage's texts if they cost fewer estimated tokens in all, else the texts before."""
    j = before.join(after.select(*keys, F.col("text").alias("new")), keys)
    j = j.withColumns({"tb": estimate(F.col("text")), "ta": estimate(F.col("new"))})
    w = W.partitionBy(request)
    j = j.withColumns({"tokens_before": F.sum("tb").over(w), "tokens_after": F.sum("ta").over(w)})
    applied = F.col("tokens_after") < F.col("tokens_before")
    return j.withColumns({"applied": applied, "text": F.when(applied, F.col("new")).otherwise(F.col("text"))}).drop("new", "tb", "ta")


def compress_report(conversations: DataFrame) -> DataFrame:
    """Per conversation: tokens before and after exact line dedup of its turns, and whether it was kept."""
    seg = conversation_segments(conversations).filter("not instruction")
    keys = ["request_id", "seg_ix"]
    gated = gate(seg, dedup_exact(seg, keys), keys)
    return gated.groupBy("request_id").agg(
        F.count("*").alias("segments"), F.first("tokens_before").alias("tokens_before"),
        F.first(F.least("tokens_after", "tokens_before")).alias("tokens_after"), F.first("applied").alias("applied"),
    )


def route_preset(segments: DataFrame, has_tools: str = "false") -> DataFrame:
    """The preset of each request: tools, then fenced code, then long multi-turn context, else aggressive."""
    g = segments.groupBy("request_id").agg(
        F.max(F.expr(has_tools)).alias("tools"), F.max(F.contains("text", F.lit("```"))).alias("fence"),
        F.count_if(~F.col("instruction")).alias("turns"), F.max(F.length("text")).alias("longest"),
    )
    route = F.when(F.col("tools"), "agent").when(F.col("fence"), "code").when((F.col("turns") >= 2) & (F.col("longest") >= 1200), "rag")
    return g.select("request_id", "turns", "longest", F.coalesce(route, F.lit("aggressive")).alias("preset"))


def frozen_prefix(segments: DataFrame, marked: Column) -> DataFrame:
    """Segments at or before the last marked turn of their request are frozen."""
    last = F.max(F.when(marked, F.col("seg_ix"))).over(W.partitionBy("request_id"))
    return segments.withColumn("frozen", F.coalesce(F.col("seg_ix") <= last, F.lit(False)))


def question(segments: DataFrame, limit: int = 600) -> DataFrame:
    """The words of each request's last user turn, empty if that turn is long."""
    last = segments.filter("role = 'user'").groupBy("request_id").agg(F.max_by("text", "seg_ix").alias("q"), F.max("seg_ix").alias("q_ix"))
    none = F.array().cast("array<string>")
    return last.select("request_id", "q_ix", F.when(F.length("q") < limit, F.array_distinct(X.words(F.col("q")))).otherwise(none).alias("query"))


def bigrams(ws: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - 1, F.lit(1))), lambda i: F.concat(ws[i - 1], F.lit(" "), F.coalesce(F.get(ws, i), F.lit(""))))


def coverage(source: Column, kept: Column, query: Column) -> Column:
    """Share of the source's query words and the word pairs around them that are kept; 1 if there are none."""
    none = F.array().cast("array<string>")
    asked = lambda q, b: F.array_contains(q, F.substring_index(b, " ", 1)) | F.array_contains(q, F.substring_index(b, " ", -1))
    near = lambda s, q: F.when(F.size(s) > 1, F.array_distinct(F.filter(bigrams(s), lambda b: asked(q, b)))).otherwise(none)

    def share(w: Column) -> Column:
        total = F.size(w["uni"]) + F.size(w["bi"])
        hit = F.size(F.array_intersect(w["uni"], w["k"])) + F.size(F.array_intersect(w["bi"], bigrams(w["k"])))
        return F.when(total > 0, hit / total).otherwise(F.lit(1.0))

    found = lambda w: F.struct(
        F.array_intersect(F.array_distinct(w["s"]), w["q"]).alias("uni"), near(w["s"], w["q"]).alias("bi"), w["k"].alias("k")
    )
    return X.let(F.struct(X.words(source).alias("s"), X.words(kept).alias("k"), query.alias("q")), lambda w: X.let(found(w), share))


def prefix_hash_chain(segments: DataFrame) -> DataFrame:
    """A hash of every prefix of a request's turns; equal prefixes of two requests have equal hashes.

    A turn's hash is that of the hash before it and its own role and text, so a request's
    turns are gathered once, as hashes, and chained link by link.
    """
    one = F.sha2(F.concat_ws("\u0001", "role", "text"), 256)
    turns = segments.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("seg_ix", one.alias("one")))).alias("turns"))
    links = F.aggregate(
        "turns", F.array().cast("array<string>"),
        lambda held, t: F.concat(held, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit("")), t["one"]), 256))),
    )
    pairs = turns.select("request_id", F.posexplode(F.arrays_zip(F.transform("turns", lambda t: t["seg_ix"]).alias("seg_ix"), links.alias("prefix"))).alias("at", "p"))
    return pairs.select("request_id", F.col("p.seg_ix").alias("seg_ix"), F.col("p.prefix").alias("prefix"))


def known_prefix(chain: DataFrame, stored: DataFrame) -> DataFrame:
    """How many leading turns of each request are stored already (stored: prefix)."""
    hit = chain.join(stored.select("prefix").distinct().withColumn("hit", F.lit(True)), "prefix", "left")
    miss = hit.groupBy("request_id").agg(F.min(F.when(F.col("hit").isNull(), F.col("seg_ix"))).alias("miss"), F.max("seg_ix").alias("last"))
    first = chain.groupBy("request_id").agg(F.min("seg_ix").alias("first"))
    return miss.join(first, "request_id").select("request_id", (F.coalesce("miss", F.col("last") + 1) - F.col("first")).cast("long").alias("reused"))

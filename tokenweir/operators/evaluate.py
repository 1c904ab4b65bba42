"""Quality measures of answers and of what survives compression, as column expressions and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tokenweir.functions import text as X

# 97.5 % quantiles of Student's t by degrees of freedom; beyond, 1.96.
T975 = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145,
    15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086, 21: 2.080, 22: 2.074, 23: 2.069, 24: 2.064, 25: 2.060, 26: 2.056, 27: 2.052,
    28: 2.048, 29: 2.045, 30: 2.042,
}


def _tokens(answer: Column) -> Column:
    return F.filter(F.split(X.answer_normal(answer), " "), lambda w: w != "")


def _common(a: Column, g: Column) -> Column:
    """Size of the common part of two sorted arrays, repetitions counted: one step per element of either."""
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(0).alias("c"))
    step = lambda s, i, j, c: F.struct((s["i"] + i).alias("i"), (s["j"] + j).alias("j"), (s["c"] + c).alias("c"))

    def merge(s: Column, _: Column) -> Column:
        x, y = F.get(a, s["i"] - 1), F.get(g, s["j"] - 1)
        return (
            F.when(x.isNull() | y.isNull(), s).when(x == y, step(s, 1, 1, 1)).when(x < y, step(s, 1, 0, 0)).otherwise(step(s, 0, 1, 0))
        )

    steps = F.when(F.size(a) + F.size(g) > 0, F.sequence(F.lit(1), F.size(a) + F.size(g))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, merge)["c"]


def token_f1(pairs: DataFrame) -> DataFrame:
    """id and F1 of common tokens, counted with repetitions (columns id, answer, gold); both empty give 1.

    Both texts stand in one row, so nothing is shuffled: their sorted tokens are merged there.
    """
    none = F.array().cast("array<string>")
    sides = pairs.select("id", *[F.coalesce(F.array_sort(_tokens(F.col(c))), none).alias(c[0]) for c in ("answer", "gold")])
    n = F.size("a") + F.size("g")
    return sides.select("id", F.when(n == 0, 1.0).otherwise(2.0 * _common(F.col("a"), F.col("g")) / n).alias("f1"))


def span_match(answer: Column, gold: Column) -> Column:
    """The gold tokens stand in the answer as a run."""
    pad = lambda c: F.concat(F.lit(" "), X.answer_normal(c), F.lit(" "))
    return F.when(X.answer_normal(gold) == "", X.answer_normal(answer) == "").otherwise(F.contains(pad(answer), pad(gold)))


def contains_match(answer: Column, gold: Column) -> Column:
    return F.contains(answer, gold)


def last_number(text: Column) -> Column:
    found = F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", ""), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("double"))


def numeric_match(answer: Column, gold: Column) -> Column:
    a, g = last_number(answer), last_number(gold)
    return F.coalesce(F.abs(a - g) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(g)), F.lit(False))


def selected_choice(answer: Column) -> Column:
    """The last stated verdict, else a bare letter, else the last letter that stands alone."""
    verdict = F.try_element_at(F.regexp_extract_all(answer, F.lit(r"(?i)(?:answer|choice|option)(?:\s+is)?\s*[:=]?\s*\(?([A-J])\b"), F.lit(1)), F.lit(-1))
    bare = F.nullif(F.regexp_extract(F.trim(answer), r"^\(?([A-Ja-j])[).]?$", 1), F.lit(""))
    alone = F.try_element_at(F.regexp_extract_all(answer, F.lit(r"(?<![\w'])\(?([A-J])[).:](?!\w)"), F.lit(1)), F.lit(-1))
    return F.upper(F.coalesce(verdict, bare, alone))


def choice_match(answer: Column, gold: Column) -> Column:
    return F.coalesce(selected_choice(answer) == F.upper(F.trim(gold)), F.lit(False))


def tool_call_match(call: Column, name: Column, keys: Column | None = None) -> Column:
    """A JSON call of the expected tool with the expected argument names; prose by standing mention."""
    said = F.coalesce(F.get_json_object(call, "$.name"), F.get_json_object(call, "$.function.name"))
    args = F.coalesce(F.get_json_object(call, "$.arguments"), F.get_json_object(call, "$.input"))
    same = F.lit(True) if keys is None else F.coalesce(F.array_sort(F.json_object_keys(args)) == F.array_sort(keys), F.lit(False))
    prose = X.mentions(call, name)
    return F.when(said.isNotNull(), (said == name) & same).otherwise(prose)


def recall(kept: Column, phrases: Column) -> Column:
    """Share of phrases that survive; 1 without phrases."""
    return F.when(F.size(phrases) == 0, 1.0).otherwise(F.size(F.filter(phrases, lambda p: F.contains(kept, p))) / F.size(phrases))


def cached_cost(tokens_in: Column, cached: Column, tokens_out: Column, rate_in: float, rate_cached: float, rate_out: float) -> Column:
    """Cost with the cached part of the input at its own rate (per thousand)."""
    c = F.least(cached, tokens_in)
    return ((tokens_in - c) * rate_in + c * rate_cached + tokens_out * rate_out) / 1000.0


def mean_ci(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean and half-width of the 95 % Student interval per group."""
    t = F.create_map(*[x for k, v in T975.items() for x in (F.lit(k), F.lit(v))])
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.coalesce(F.try_element_at(t, (F.col("n") - 1).cast("int")), F.lit(1.96)) * F.col("sd") / F.sqrt("n")
    return g.select(group, "n", "mean", F.when(F.col("n") > 1, half).otherwise(0.0).alias("half_width"))


def frontier(outcomes: DataFrame, group: str) -> DataFrame:
    """Token-weighted savings and mean quality before and after (columns in_before, in_after, q_before, q_after)."""
    g = outcomes.groupBy(group).agg(
        F.count("*").alias("cases"), F.sum("in_before").alias("in_before"), F.sum("in_after").alias("in_after"),
        F.avg("q_before").alias("q_before"), F.avg("q_after").alias("q_after"),
        F.avg(F.when(F.col("q_before") > 0, F.col("q_after") / F.col("q_before"))).alias("retention"),
    )
    return g.withColumn("saved_pct", F.when(F.col("in_before") > 0, (F.col("in_before") - F.col("in_after")) * 100.0 / F.col("in_before")).otherwise(0.0))


def percentiles(rows: DataFrame, group: str, value: str, qs=(0.5, 0.95)) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return rows.groupBy(group).agg(*[F.percentile(value, q).alias(f"p{round(q * 100)}") for q in qs])


#: Rows and draws worked on at once, and groups whose sums a task holds.
BLOCK, HELD_GROUPS = 1000, 200


def bootstrap(rows: DataFrame, group: str, value: str, key: list[str], weight: str | None = None, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """95 % bootstrap interval of the mean per group, of `value` or, with `weight`, of value / weight sums.

    Every row is drawn Poisson(1) times, by a hash of its key, the draw and the seed, so
    reruns and partitionings agree. Sums are made before the shuffle: two numbers per draw,
    group and partition travel, and no group has to fit into a task.
    """
    kind = dict(rows.dtypes)[group]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    given = rows.filter(F.col(value).isNotNull() & w.isNotNull()).select(
        F.col(group).alias("g"), F.xxhash64(F.lit(seed), *[F.col(k) for k in key]).alias("k"), F.col(value).cast("double").alias("v"), w.alias("w")
    )
    # Poisson(1) counts by inversion of a uniform number
    levels = np.cumsum(1 / np.cumprod(np.concatenate([[1.0], np.arange(1, 13)]))) / np.e

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        ready = lambda: pd.concat([pd.DataFrame({"g": g, "d": np.arange(draws), "s": x[0], "n": x[1]}) for g, x in held.items()])
        for batch in batches:
            for g, rows in batch.groupby("g", dropna=False):
                sums = held.setdefault(g, np.zeros((2, draws)))
                for at in range(0, len(rows), BLOCK):
                    part = rows.iloc[at : at + BLOCK]
                    k, both = part.k.to_numpy().astype(np.uint64), part[["v", "w"]].to_numpy().T
                    for d in range(0, draws, BLOCK):
                        x = mixed(k[:, None] ^ mixed(np.arange(d, min(draws, d + BLOCK), dtype=np.uint64))[None, :])
                        sums[:, d : d + BLOCK] += both @ np.searchsorted(levels, (x >> np.uint64(11)) / float(1 << 53))
            if len(held) > HELD_GROUPS:
                yield ready()
                held.clear()
        if held:
            yield ready()

    drawn = given.mapInPandas(partial, f"g {kind}, d int, s double, n double").groupBy("g", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    ends = drawn.groupBy("g").agg(F.percentile(mean, 0.025).alias("lo"), F.percentile(mean, 0.975).alias("hi"))
    whole = given.groupBy(F.col("g").alias("h")).agg((F.sum("v") / F.sum("w")).alias("mean"))
    return whole.join(ends, F.col("h").eqNullSafe(F.col("g"))).select(F.col("h").cast("string").alias("g"), "mean", "lo", "hi")


def paired_bootstrap(rows: DataFrame, group: str, before: str, after: str, key: list[str], **options) -> DataFrame:
    """95 % bootstrap interval of the mean difference after - before of the same cases."""
    both = rows.withColumn("__difference", F.col(after).cast("double") - F.col(before).cast("double"))
    return bootstrap(both, group, "__difference", key, **options)


def mixed(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (v + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(32))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """id and the F measure of the longest common token subsequence (columns id, answer, gold)."""

    def lcs(a: list[str], b: list[str]) -> int:
        """Length of the longest common subsequence, a row of the table per whole number."""
        at: dict[str, int] = {}
        for i, w in enumerate(b):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(b)) - 1
        row = full
        for w in a:
            hit = row & at.get(w, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(b) - row.bit_count()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for a, g in zip(p.a, p.g):
                a, g = list(a), list(g)
                n = lcs(a, g)
                out.append(2 * n / (len(a) + len(g)) if len(a) + len(g) else 1.0)
            yield pd.DataFrame({"id": p.id, "rouge_l": out})

    return pairs.select("id", _tokens(F.col("answer")).alias("a"), _tokens(F.col("gold")).alias("g")).mapInPandas(work, "id long, rouge_l double")


def prefix_stability(turns: DataFrame, group: str, pos: str) -> DataFrame:
    """Characters that each request body shares with the one before it in its loop (column body)."""
    from pyspark.sql import Window as W

    prev = F.lag("body").over(W.partitionBy(group).orderBy(pos))
    # the length of the common beginning, found by halving; a prefix that is shared has all shorter ones
    halve = lambda s, _: F.struct(
        F.when(_same(F.col("body"), F.col("__before"), _middle(s)), _middle(s)).otherwise(s["lo"]).alias("lo"),
        F.when(_same(F.col("body"), F.col("__before"), _middle(s)), s["hi"]).otherwise(_middle(s) - 1).alias("hi"),
    )
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.col("__both") + 2)).cast("int"))
    turns = turns.withColumn("__before", prev).withColumn("__both", F.least(F.length("body"), F.length("__before")))
    n = F.when(F.col("__before").isNull(), 0).otherwise(F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.col("__both").alias("hi")), halve)["lo"])
    return turns.select(group, pos, F.length("body").alias("chars"), n.cast("long").alias("shared"))


def _middle(s: Column) -> Column:
    return F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")


def _same(a: Column, b: Column, n: Column) -> Column:
    return F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)


def residual(captures: DataFrame) -> DataFrame:
    """What stays uncompressed, by kind and tool (columns kind, tool, tokens_before, tokens_after), ranked, with shares."""
    from pyspark.sql import Window as W

    g = captures.groupBy("kind", "tool").agg(
        F.sum("tokens_after").alias("residual"), F.sum("tokens_before").alias("before"), F.countDistinct("capture").alias("captures")
    )
    total = F.sum("residual").over(W.partitionBy())
    return g.select(
        "kind", "tool", "residual", "before", "captures", (F.col("residual") * 100.0 / total).alias("share_pct"),
        F.when(F.col("before") > 0, (F.col("before") - F.col("residual")) * 100.0 / F.col("before")).otherwise(0.0).alias("compressed_pct"),
    )

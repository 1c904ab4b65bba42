"""Ledger queries: savings, cost, sessions and trends over turns, blocks and compressions.

All are partial aggregates over one scan. Results per model, agent or day are small; those
per session grow with the ledger and stay distributed. Bare columns beside a maximum are
taken from the row of that maximum by `max_by`, which needs no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tokenweir.functions import ledger_math as M


def _sum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def summary(compressions: DataFrame) -> DataFrame:
    """Counts and sums per provider, in one pass."""
    metered = F.col("frozen_input_tokens").isNotNull()
    return compressions.groupBy("provider").agg(
        F.count("*").alias("events"),
        _sum("input_before").alias("input_before"),
        _sum("input_after").alias("input_after"),
        F.count_if(~F.col("exact")).alias("inexact"),
        F.count("output_after").alias("with_output"),
        F.avg("compress_micros").alias("avg_micros"),
        F.max("ts").alias("last_ts"),
        _sum(F.when(metered, F.col("input_before"))).alias("metered_before"),
        _sum(F.when(metered, F.col("input_after"))).alias("metered_after"),
        _sum("frozen_input_tokens").alias("frozen"),
    )


def by_model(compressions: DataFrame, since: str | None = None) -> DataFrame:
    """Per provider and model; fresh input falls back to what the cache did not serve."""
    rows = compressions if since is None else compressions.filter(F.col("ts") >= since)
    cached = F.coalesce("cache_read_tokens", F.lit(0))
    fresh = F.coalesce("fresh_input_tokens", F.greatest(F.col("input_after") - cached, F.lit(0)))
    return rows.groupBy("provider", "model").agg(
        F.count("*").alias("events"),
        _sum("input_before").alias("input_before"),
        _sum("input_after").alias("input_after"),
        _sum(cached).alias("cache_read"),
        _sum(fresh).alias("fresh"),
        _sum(F.when(F.col("output_shaped"), F.col("output_after"))).alias("shaped_output"),
    )


def by_period(compressions: DataFrame, period: str) -> DataFrame:
    return compressions.groupBy(M.PERIODS[period](F.col("ts")).alias("period")).agg(
        F.count("*").alias("events"), _sum("input_before").alias("input_before"), _sum("input_after").alias("input_after")
    ).withColumn("saved", F.col("input_before") - F.col("input_after")).withColumn(
        "saved_pct", M.saved_percent(F.col("input_before"), F.col("input_after"))
    )


def _turn_sums() -> list[Column]:
    return [
        F.count("*").alias("turns"),
        _sum("input_before").alias("input_before"),
        _sum(F.when(F.col("input_before").isNotNull(), F.col("input_after"))).alias("input_after"),
        _sum("bill_micros").alias("bill_micros"),
        _sum("cache_read").alias("cache_read"),
        (F.count("input_before") > 0).alias("has_savings_data"),
        F.max("ts").alias("last_ts"),
    ]


def agent_aggregates(turns: DataFrame) -> DataFrame:
    return turns.groupBy("agent").agg(*_turn_sums())


def project_aggregates(turns: DataFrame, agent: str) -> DataFrame:
    """Null is a project of its own."""
    return turns.filter(F.col("agent") == agent).groupBy("project").agg(*_turn_sums())


def session_aggregates(turns: DataFrame, agent: str, project: str | None) -> DataFrame:
    """Sessions of an agent's project (null-safe), the name from the latest row."""
    mine = turns.filter((F.col("agent") == agent) & F.col("project").eqNullSafe(project))
    return mine.groupBy("session_id").agg(*_turn_sums(), F.max_by("session_name", F.struct("ts", "id")).alias("session_name"))


def agent_trend(turns: DataFrame, agent: str, period: str, n: int) -> DataFrame:
    """The last n periods of an agent."""
    t = turns.filter(F.col("agent") == agent).groupBy(M.PERIODS[period](F.col("ts")).alias("period")).agg(
        _sum("input_before").alias("input_before"), _sum(F.when(F.col("input_before").isNotNull(), F.col("input_after"))).alias("input_after")
    )
    return t.orderBy(F.col("period").desc()).limit(n).orderBy("period")


def sessions(turns: DataFrame) -> DataFrame:
    """Per session, harness session, agent and project; labels from the latest named row."""
    named = F.when(F.col("session_name").isNotNull(), F.col("id"))
    return turns.groupBy("session_id", "cc_session_id", "agent", "project").agg(
        F.count("*").alias("turns"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by("session_name", named).alias("session_name"),
        F.max_by("model", "id").alias("model"),
        F.max_by("win", "id").alias("win"),
        _sum("fresh_input").alias("fresh_input"),
        _sum("cache_read").alias("cache_read"),
        _sum("cache_write").alias("cache_write"),
        _sum("output_tok").alias("output_tok"),
        _sum("bill_micros").alias("bill_micros"),
        F.max("id").alias("last_id"),
        F.max_by(F.col("fresh_input") + F.col("cache_read") + F.col("cache_write"), "id").alias("last_input"),
    )


def category(b: DataFrame) -> DataFrame:
    """Blocks with mcp_server, group_label and label from zone, section, bucket and role."""
    server = M.mcp_server(F.col("tool_name"))
    tool = F.when(F.col("bucket").isin("tool_use", "tool_result"), F.when(server.isNotNull(), "MCP tool use+output").otherwise("system tool use+output"))
    static = F.when(F.col("bucket") == "system", "System prompt").when(
        F.col("bucket") == "schema", F.when(server.isNotNull(), "MCP tools").otherwise("System tools")
    )
    text = F.when(F.col("bucket") == "text", F.when(F.col("role") == "user", "user text").otherwise("assistant text"))
    out, fixed = F.col("zone") == "output", F.col("section") == "static"
    return b.withColumns(
        {
            "mcp_server": server,
            "group_label": F.when(out, "Output").when(fixed, "Static").otherwise("Messages"),
            "label": F.coalesce(F.when(out, tool).when(fixed, static).otherwise(F.coalesce(text, tool)), "bucket"),
        }
    )


def occupancy(blocks: DataFrame, turn_id: int | None = None) -> DataFrame:
    """Input tokens by category of each turn, or of the one asked for."""
    mine = F.lit(True) if turn_id is None else F.col("turn_id") == turn_id
    return (
        category(blocks).filter(mine & (F.col("zone") == "input"))
        .groupBy("turn_id", "section", "bucket", "group_label", "label").agg(_sum("raw_tokens").alias("raw_tokens"))
    )


def cost_by_source(blocks: DataFrame, turns: DataFrame, session_id: str | None = None) -> DataFrame:
    """Tokens times the turn's rates by source: the ledger's one join, on the turn's key."""
    t = turns.select(F.col("id").alias("t_id"), "session_id", "input_rate", "output_rate", "fresh_input", "cache_read", "cache_write", "cache_read_rate", "cache_write_rate")
    if session_id is not None:
        t = t.filter(F.col("session_id") == session_id)
    return (
        prefix_tape(blocks, turns).join(t, F.col("turn_id") == F.col("t_id"))
        .groupBy("group_label", "label")
        .agg(
            F.sum(F.col("fresh_tok") * F.col("input_rate") / 1e6).alias("fresh_usd"),
            F.sum((F.col("cache_read_tok") * F.col("cache_read_rate") + F.col("cache_write_tok") * F.col("cache_write_rate")) / 1e6).alias("cache_usd"),
            F.sum(F.col("output_tok_share") * F.col("output_rate") / 1e6).alias("output_usd"),
        )
        .withColumn("total_usd", F.col("fresh_usd") + F.col("cache_usd") + F.col("output_usd"))
    )


def prefix_tape(blocks: DataFrame, turns: DataFrame) -> DataFrame:
    """Input blocks in wire order scaled to the billed input, then dealt to cache read, cache write, fresh.

    The running position of a block on the tape is a window over its turn (a handful of
    rows); shares are overlaps of [start, end) with [0, read), [read, read + write), rest.
    """
    t = turns.select(
        F.col("id").alias("t_id"), F.col("cache_read").alias("r"), F.col("cache_write").alias("w"), F.col("output_tok").alias("o"),
        (F.col("fresh_input") + F.col("cache_read") + F.col("cache_write")).alias("billed"),
    )
    b = category(blocks).join(t, F.col("turn_id") == F.col("t_id"))
    zone = W.partitionBy("turn_id", "zone")
    total = F.sum("raw_tokens").over(zone)
    end = F.sum("raw_tokens").over(zone.orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow))
    paid = F.when(F.col("zone") == "input", F.col("billed")).otherwise(F.col("o"))
    scale = F.when((paid > 0) & (total > 0), paid.cast("double") / total).otherwise(F.lit(1.0))  # no usage: raw counts
    b = b.withColumns({"hi": end * scale, "lo": (end - F.col("raw_tokens")) * scale})
    zero = F.lit(0.0)
    overlap = lambda a, z: F.greatest(F.least("hi", z) - F.greatest("lo", a), zero)
    r, rw = F.col("r").cast("double"), (F.col("r") + F.col("w")).cast("double")
    is_input = F.col("zone") == "input"
    return b.select(
        "id", "turn_id", "zone", "section", "bucket", "group_label", "label", "mcp_server", "tool_name", "raw_tokens",
        F.when(is_input, overlap(rw, F.greatest("hi", rw))).otherwise(zero).alias("fresh_tok"),
        F.when(is_input, overlap(zero, r)).otherwise(zero).alias("cache_read_tok"),
        F.when(is_input, overlap(r, rw)).otherwise(zero).alias("cache_write_tok"),
        F.when(is_input, zero).otherwise(F.col("hi") - F.col("lo")).alias("output_tok_share"),
    )


def with_saved(turns: DataFrame) -> DataFrame:
    return turns.withColumn("saved_micros", M.saved_micros())


def unpriced(turns: DataFrame) -> Column:
    rates = (F.col("input_rate") == 0) & (F.col("output_rate") == 0) & (F.col("cache_read_rate") == 0) & (F.col("cache_write_rate") == 0)
    return rates & (F.col("bill_micros") == 0) & F.col("model").isNotNull()


def unpriced_models(turns: DataFrame) -> DataFrame:
    return turns.filter(unpriced(turns)).select("model").distinct()


def money_totals(turns: DataFrame, since: str | None = None) -> DataFrame:
    rows = turns if since is None else turns.filter(F.col("ts") >= since)
    u = unpriced(turns)
    return with_saved(rows).agg(
        F.count("*").alias("turns"),
        _sum("saved_micros").alias("saved_micros"),
        _sum("bill_micros").alias("paid_micros"),
        F.count_if(u).alias("unpriced_turns"),
        F.countDistinct(F.when(u, F.col("model"))).alias("unpriced_models"),
    )


def money_by_day(turns: DataFrame, n: int) -> DataFrame:
    """The newest n days, in ascending order."""
    d = with_saved(turns).groupBy(M.day(F.col("ts")).alias("day")).agg(_sum("saved_micros").alias("saved_micros"), _sum("bill_micros").alias("paid_micros"))
    return d.orderBy(F.col("day").desc()).limit(n).orderBy("day")


def money_by_model(turns: DataFrame, n: int) -> DataFrame:
    m = with_saved(turns).groupBy(F.coalesce("model", F.lit("(unknown)")).alias("model")).agg(
        F.count("*").alias("turns"), _sum("saved_micros").alias("saved_micros"), _sum("bill_micros").alias("paid_micros")
    )
    return m.orderBy(F.col("saved_micros").desc(), F.col("paid_micros").desc(), "model").limit(n)


def padded_daily_saved(turns: DataFrame, n: int) -> DataFrame:
    """n days ending at the newest one, zeros where nothing was saved."""
    d = with_saved(turns).groupBy(F.to_date(M.day(F.col("ts"))).alias("d")).agg((F.sum("saved_micros") / 1e6).alias("saved_usd"))
    last = turns.agg(F.max(F.to_date(M.day(F.col("ts")))).alias("last"))
    days = last.select(F.explode(F.sequence(F.date_sub("last", n - 1), F.col("last"))).alias("day"))
    return days.join(d, F.col("day") == F.col("d"), "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("saved_usd", F.lit(0.0)).alias("saved_usd")
    )


def money_coverage(turns: DataFrame, compressions: DataFrame) -> DataFrame:
    """Turns with money per compression event, clamped to [0, 1]; 1 without events."""
    t = turns.agg(F.count("*").alias("turns"))
    c = compressions.agg(F.count("*").alias("events"))
    share = F.when(F.col("events") == 0, F.lit(1.0)).otherwise(F.least(F.col("turns") / F.col("events"), F.lit(1.0)))
    return t.crossJoin(c).select(  # one row on either side
        "turns", "events", share.alias("coverage"),
        ((F.col("events") > 0) & (F.col("turns") == 0)).alias("traffic_without_money"),
        ((F.col("turns") > 0) & (share < 1.0)).alias("partial"),
    )


def session_bill(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(_sum("bill_micros").alias("bill_micros"))


def dashboard(turns: DataFrame) -> DataFrame:
    """A card per agent with its label, and the total whose percentage comes from the sums."""
    cards = agent_aggregates(turns).select(M.title_case(F.col("agent")).alias("card"), "turns", "input_before", "input_after", "bill_micros")
    total = cards.agg(F.lit("total").alias("card"), *[F.sum(c).cast("long").alias(c) for c in ("turns", "input_before", "input_after", "bill_micros")])
    return cards.union(total).withColumn("saved_pct", M.trimmed_percent(F.col("input_before"), F.col("input_after")))


def reprice(turns: DataFrame, rates: DataFrame) -> DataFrame:
    """Turns whose rates are all zero get those of `rates` (model, in_rate, out_rate) and a new bill."""
    r = rates.select(F.col("model").alias("r_model"), "in_rate", "out_rate", "read_share", "write_share")
    j = turns.join(r, F.col("model") == F.col("r_model"), "left")
    fix = unpriced(turns) & F.col("r_model").isNotNull()
    new_in = F.when(fix, F.col("in_rate")).otherwise(F.col("input_rate"))
    new_out = F.when(fix, F.col("out_rate")).otherwise(F.col("output_rate"))
    read = F.when(fix, F.col("in_rate") * F.col("read_share")).otherwise(F.col("cache_read_rate"))
    write = F.when(fix, F.col("in_rate") * F.col("write_share")).otherwise(F.col("cache_write_rate"))
    bill = M.round_half_up(F.col("fresh_input") * new_in + F.col("cache_read") * read + F.col("cache_write") * write + F.col("output_tok") * new_out)
    return j.select(
        "id", "model", new_in.alias("input_rate"), new_out.alias("output_rate"), F.when(fix, bill).otherwise(F.col("bill_micros")).alias("bill_micros")
    )


def prune(rows: DataFrame, keep_since: str, keep_rows: int) -> DataFrame:
    """What retention leaves: not older than keep_since and among the newest ids."""
    top = rows.agg(F.max("id").alias("top"))
    return rows.join(F.broadcast(top)).filter((F.col("ts") >= keep_since) & (F.col("id") > F.col("top") - keep_rows)).drop("top")


def prune_blocks(blocks: DataFrame, kept_turns: DataFrame) -> DataFrame:
    """Blocks go with their turns."""
    return blocks.join(kept_turns.select(F.col("id").alias("turn_id")), "turn_id", "left_semi")


def model_views(compressions: DataFrame, top: int = 8) -> DataFrame:
    """The busiest models: cached or fresh, and how much of the new content is saved."""
    frozen = F.col("frozen_input_tokens")
    g = compressions.groupBy("provider", "model").agg(
        F.count("*").alias("events"),
        _sum("cache_read_tokens").alias("cache_read"),
        _sum(F.when(frozen.isNotNull(), F.col("input_before"))).alias("mb"),
        _sum(F.when(frozen.isNotNull(), F.col("input_after"))).alias("ma"),
        _sum(frozen).alias("frozen"),
    )
    return g.orderBy(F.col("events").desc(), "provider", F.col("model").asc_nulls_first()).limit(top).select(
        "provider", "model", "events", (F.col("cache_read") > 0).alias("cached"),
        F.when(F.col("frozen") > 0, M.saved_percent(F.col("mb") - F.col("frozen"), F.col("ma") - F.col("frozen"))).alias("new_content_pct"),
    )


def cost_estimate(per_model: DataFrame, prices: DataFrame) -> DataFrame:
    """Spend and savings over `by_model` rows at `prices` (id, input_rate); unpriced models are left out."""
    mult = F.create_map(*[x for p, (r, w) in M.CACHE_MULTIPLIERS.items() for x in (F.lit(p), F.array(F.lit(r), F.lit(w)))])
    read = F.coalesce(mult[F.col("provider")][0], F.lit(M.OTHER_MULTIPLIERS[0]))
    j = resolve_prices(per_model, prices)
    p = F.least(F.greatest((F.col("input_before") - F.col("input_after")).cast("double") / F.col("input_before"), F.lit(0.0)), F.lit(M.MAX_SAVED_SHARE))
    net = (F.col("fresh") + F.col("cache_read") * read) * F.col("input_rate") / 1e6
    # decimals: a sum of doubles depends on the order of its rows
    total = lambda x, name: F.sum(x.cast("decimal(38,12)")).cast("double").alias(name)
    return j.filter("input_rate is not null").agg(
        total((F.col("input_before") - F.col("input_after")) * F.col("input_rate") / 1e6, "saved_usd"),
        total(F.col("input_after") * F.col("input_rate") / 1e6, "spend_usd"),
        total(net, "net_spend_usd"),
        total(net * p / (1 - p), "net_saved_usd"),
    )


def resolve_prices(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Price by exact id, then by the id after the first slash, then by an unambiguous bare alias.

    Plain joins: Spark broadcasts the price list where its size allows it.
    """
    exact = prices.select(F.col("id").alias("p1"), F.col("input_rate").alias("r1"))
    alias = (
        prices.filter(F.instr("id", "/") > 0).groupBy(F.element_at(F.split("id", "/"), -1).alias("p3"))
        .agg(F.count("*").alias("k"), F.first("input_rate").alias("r3")).filter("k = 1").drop("k")
    )
    short = F.when(F.instr("model", "/") > 0, F.substring_index("model", "/", -1)).otherwise(F.col("model"))
    return (
        rows.join(exact, F.col("model") == F.col("p1"), "left")
        .join(exact.toDF("p2", "r2"), short == F.col("p2"), "left")
        .join(alias, F.col("model") == F.col("p3"), "left")
        .withColumn("input_rate", F.coalesce("r1", "r2", "r3")).drop("p1", "r1", "p2", "r2", "p3", "r3")
    )

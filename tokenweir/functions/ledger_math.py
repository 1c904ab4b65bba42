"""Column formulas of the ledger: periods, percentages, money and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Share of the input price for cache reads and writes, by provider.
CACHE_MULTIPLIERS = {"anthropic": (0.10, 1.25), "openai": (0.50, 0.0), "google": (0.25, 0.0)}
OTHER_MULTIPLIERS = (1.0, 0.0)
#: The share of the input that a turn may count as saved, at most.
MAX_SAVED_SHARE = 0.95


def day(ts: Column) -> Column:
    return F.substring(ts, 1, 10)


def month(ts: Column) -> Column:
    return F.substring(ts, 1, 7)


def week(ts: Column) -> Column:
    """`YYYY-Www`, weeks start on Monday, days before the first Monday are week 00."""
    d = F.to_date(day(ts))
    number = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


PERIODS = {"day": day, "week": week, "month": month}


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is not positive."""
    return F.when(whole > 0, part.cast("double") / whole * 100.0).otherwise(F.lit(0.0))


def saved_percent(before: Column, after: Column) -> Column:
    return percent(before - after, before)


def trimmed_percent(before: Column, after: Column) -> Column:
    """As saved_percent, never below 0."""
    return percent(F.greatest(before - after, F.lit(0)), before)


def round_half_up(x: Column) -> Column:
    """Nearest long for values that are not negative."""
    return F.floor(x + 0.5).cast("long")


def input_bill(turn: dict[str, Column]) -> Column:
    return (
        turn["fresh_input"] * turn["input_rate"]
        + turn["cache_read"] * turn["cache_read_rate"]
        + turn["cache_write"] * turn["cache_write_rate"]
    )


def saved_micros() -> Column:
    """What the removed input would have cost: bill * p / (1 - p), p being the removed share."""
    c = {n: F.col(n) for n in ("fresh_input", "input_rate", "cache_read", "cache_read_rate", "cache_write", "cache_write_rate")}
    share = (F.col("input_before") - F.col("input_after")).cast("double") / F.col("input_before")
    p = F.least(F.greatest(share, F.lit(0.0)), F.lit(MAX_SAVED_SHARE))
    bill = F.greatest(round_half_up(input_bill(c)), F.lit(0))
    metered = (F.col("input_before") > 0) & F.col("input_after").isNotNull()
    return F.when(metered, round_half_up(bill * p / (1 - p))).otherwise(F.lit(0)).cast("long")


def title_case(name: Column) -> Column:
    """Words between `-`, `_` and blanks, their first letters raised, the rest as it is."""
    words = F.filter(F.split(name, "[-_ ]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def project_label(project: Column) -> Column:
    base = F.element_at(F.filter(F.split(project, "[/\\\\]"), lambda p: p != ""), -1)
    return F.coalesce(F.when(F.size(F.filter(F.split(project, "[/\\\\]"), lambda p: p != "")) > 0, base), F.lit("(no project)"))


def session_label(name: Column, session: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(session, F.lit("")), F.lit("(unnamed session)"))


def mcp_server(tool: Column) -> Column:
    """The server of a tool named `mcp__<server>__<tool>`, else null."""
    return F.nullif(F.regexp_extract(tool, r"^mcp__(.*?)(?:__|$)", 1), F.lit(""))

"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

Every assistant turn becomes an example of its own: all preceding turns are context, only
the reply is under the loss mask. Turns are marked `<|im_start|>role\\n...<|im_end|>\\n`;
control strings inside texts are escaped so that they can't be taken for marks and come
back unchanged. Turns after the last reply form one example without loss, so that the
output holds the whole conversation.

Defined cases: null text or role is empty; turns that share a number are ordered by role
and text, repeated rows are turns of their own; a null conv_id is a conversation; a very
long conversation is formatted in one row, its examples after one another (their sizes add
up to the square of its turns, as prefix expansion has it); an empty table gives no
examples; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tokenweir.functions.text import let

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    """Doubles backslashes, then breaks `<|` with one: `<\\|` comes from `<|` alone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    out = F.replace(role, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def unescape_role(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("%3C|"), F.lit("<|")), F.lit("%0A"), F.lit("\n"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example long, context, target (null where nothing is trainable), suffix.

    context || target || suffix is the formatted text; the loss mask covers target alone.
    A conversation is gathered in one row, as its formatted text has to be.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    marked = grouped.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t: F.struct(
                (t["role"] == "assistant").alias("reply"),
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
                escape_text(t["text"]).alias("body"),
            ),
        ).alias("ms"),
    )
    # every example is made inside the row, so that what is exploded carries its own text alone
    def examples(ms: Column) -> Column:
        def made(turns: Column) -> Column:
            whole = lambda upto: F.array_join(F.slice(turns, 1, upto), "")
            rest = F.lit(END + "\n")
            one = lambda m, i: F.struct(
                i.cast("long").alias("example"),
                F.when(m["reply"], F.concat(whole(i), m["head"])).otherwise(whole(F.size(ms))).alias("context"),
                F.when(m["reply"], m["body"]).alias("target"),
                F.when(m["reply"], rest).otherwise(F.lit("")).alias("suffix"),
            )
            last = lambda m, i: m["reply"] | (i == F.size(ms) - 1)
            made = F.transform(ms, lambda m, i: F.when(last(m, i), one(m, i)))
            return F.filter(made, lambda x: x.isNotNull())

        return let(F.transform(ms, lambda m: F.concat(m["head"], m["body"], F.lit(END + "\n"))), made)

    return marked.select("conv_id", F.explode(let(F.col("ms"), examples)).alias("x")).select("conv_id", "x.*")


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs of a formatted conversation, unescaped."""
    parts = F.filter(F.split(formatted, r"\Q" + END + r"\E\n"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape_text(
                F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)
            ).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns, loss text and sizes."""
    full = F.concat(F.col("context"), F.coalesce(F.col("target"), F.lit("")), F.col("suffix"))
    g = examples.withColumn("full", full).groupBy("conv_id").agg(
        F.max_by("full", "example").alias("full"),
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("ts"),
        F.sum(F.length("full")).cast("long").alias("formatted_chars"),
    )
    return g.select(
        "conv_id",
        read_turns(F.col("full")).alias("turns"),
        F.array_join(F.transform("ts", lambda t: unescape_text(t["target"])), "").alias("loss"),
        "formatted_chars",
    )

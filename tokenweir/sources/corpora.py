"""File sources and sinks around the pipeline: captures, case files, transcripts, exports, price tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

CAPTURE = "ts string, provider string, model string, input_before long, input_after long, output_shaped boolean, stages array<string>, plan string, before string, after string"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture envelopes of a folder, one file each; torn files have null fields and `skipped`."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.col("_metadata.file_name"))
    v = F.from_json("value", CAPTURE)
    return raw.select("file", v.alias("v")).select("file", "v.*", (F.col("v.before").isNull() & F.col("v.after").isNull()).alias("skipped"))


def retained(files: DataFrame, max_bytes: int) -> DataFrame:
    """The newest capture files (file, size) whose sizes add up to at most max_bytes."""
    newest = W.orderBy(F.col("file").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return files.withColumn("kept_bytes", F.sum("size").over(newest)).filter(F.col("kept_bytes") <= max_bytes)


def bench_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case lines, explicit (request, gold, scorer) or friendly (system, context, question or prompt)."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    g = lambda *ks: F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in ks])
    said = F.concat_ws("\n\n", g("context"), g("question", "prompt"))
    msgs = F.array_compact(F.array(F.when(g("system").isNotNull(), F.struct(F.lit("system").alias("role"), g("system").alias("content"))), F.struct(F.lit("user").alias("role"), said.alias("content"))))
    gold = F.coalesce(F.from_json(g("gold"), "array<string>"), F.array(g("gold")))
    return raw.select(g("name").alias("name"), F.coalesce(g("request"), F.to_json(F.struct(msgs.alias("messages")))).alias("body"), gold.alias("gold"), g("scorer").alias("scorer"))


def recall_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case lines with aliases: context or input, question or query, answers or answer or expected."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    g = lambda *ks: F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in ks])
    a = g("answers", "answer", "expected")
    return raw.select(g("context", "input").alias("context"), g("question", "query").alias("question"), F.coalesce(F.from_json(a, "array<string>"), F.array(a)).alias("answers"))


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """Per file, the newest time and the tokens of the last usage; bad lines and side chains don't count."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    g = lambda p: F.get_json_object("value", p)
    n = lambda p: F.coalesce(g(f"$.message.usage.{p}").cast("long"), F.lit(0))
    rows = raw.filter(F.coalesce(g("$.isSidechain"), F.lit("false")) != "true").select(
        "file", g("$.timestamp").alias("ts"), g("$.message.usage").isNotNull().alias("used"),
        (n("input_tokens") + n("cache_creation_input_tokens") + n("cache_read_input_tokens")).alias("tokens"),
    )
    return rows.filter("ts is not null").groupBy("file").agg(F.max("ts").alias("ts"), F.max_by("tokens", F.when(F.col("used"), F.col("ts"))).alias("tokens"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_ledger(df: DataFrame, path: str, day: str = "ts") -> None:
    """Adds rows to a ledger table partitioned by day, so that retention drops whole partitions."""
    df.withColumn("day", F.substring(day, 1, 10)).write.mode("append").partitionBy("day").parquet(path)


def model_facts(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Context, rating and reasoning flag of each row's model (registry: id, context, rating, reasoning).

    Names compare in lower case without what stands before the first slash; rating and flag
    fall back to dated variants `id-<digit>...` (largest rating, any flag). Plain joins: Spark
    broadcasts the registry where its size allows it.
    """
    name = F.lower(F.when(F.instr("model", "/") > 0, F.substring_index("model", "/", -1)).otherwise(F.col("model")))
    r = registry.withColumn("id", F.lower("id"))
    dated = r.withColumn("base", F.regexp_extract("id", r"^(.+?)-\d", 1)).filter("base <> ''").groupBy("base").agg(F.max("rating").alias("r2"), F.max("reasoning").alias("f2"))
    return (
        rows.withColumn("__m", name).join(r, F.col("__m") == F.col("id"), "left").join(dated, F.col("__m") == F.col("base"), "left")
        .withColumns({"rating": F.coalesce("rating", "r2"), "reasoning": F.coalesce("reasoning", "f2", F.lit(False))}).drop("__m", "id", "base", "r2", "f2")
    )


def image_target(width, height, long: int, short: int | None = None, pixels: int | None = None, tile: int | None = None):
    """Target size of an image under a provider's caps: the smallest ratio, floored, snapped down to near tiles."""
    hi, lo = F.greatest(width, height), F.least(width, height)
    ratios = [F.lit(1.0), F.lit(float(long)) / hi]
    ratios += [F.lit(float(short)) / lo] if short else []
    ratios += [F.sqrt(F.lit(float(pixels)) / (width * height))] if pixels else []
    scale = F.least(*ratios)

    def side(x):
        v = F.greatest(F.floor(x * scale), F.lit(1))
        return F.when((v > tile) & (v % tile < tile // 10), v - v % tile).otherwise(v) if tile else v

    return F.struct(side(width).cast("int").alias("width"), side(height).cast("int").alias("height"))


# Image caps (long side, short side, pixels, tile) by provider.
IMAGE_CAPS = {"openai": (2048, 768, None, 512), "anthropic": (1568, None, 1_150_000, None), "google": (3072, None, None, None)}

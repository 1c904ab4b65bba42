"""Shared helpers of the training-data operators: tables, shared storage, row identity."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder, read by Spark only (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only a local session may go without the setting; it gets a fresh temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = os.path.join(tempfile.gettempdir(), "checkpoints", f"tokenweir-{os.getpid()}")
    os.makedirs(base, exist_ok=True)
    return f"file://{base}"


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; Hadoop removes it when the session's JVM ends."""
    path = f"{shared_dir(spark)}/tokenweir/{label}-{uuid.uuid4().hex}"
    fs, hadoop = _hadoop(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes what new_path named, before the session ends."""
    fs, hadoop = _hadoop(spark, path)
    fs.delete(hadoop, True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """`df` as a table in the shared folder, and its path: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return spark.read.schema(schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    return written(df, label)[0]


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more.

    Its cleaner works when the driver's JVM collects garbage, which a long run of small
    driver work doesn't cause.
    """
    spark.sparkContext._jvm.System.gc()


def packed_row(df: DataFrame, out: str = "__row"):
    """All columns of `df` as one struct, so that no name of theirs meets a name of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(out)


def with_row_key(df: DataFrame, id_col: str, rank_by: str = "text") -> DataFrame:
    """`__key`, a unique, non-null long that sorts as `id_col` (nulls first), and `__row`, all columns of df.

    Where the ids are unique and not null, they are the keys (one aggregate of the ids
    finds out). Otherwise rows are sorted once by id and by the SHA-256 of `rank_by` (rows
    that are equal in both are dealt out evenly) and numbered through a written table, so
    that a recomputed task sees the same numbers.
    """
    seen = df.groupBy(F.col(id_col).alias("i")).agg(F.count("*").alias("n")).agg(
        F.max("n").alias("most"), F.sum(F.col("i").isNull().cast("int")).alias("nulls")
    ).first()
    kind = dict(df.dtypes)[id_col]
    row = packed_row(df)
    if kind in ("tinyint", "smallint", "int", "bigint") and (seen["most"] or 0) <= 1 and not seen["nulls"]:
        return df.select(F.col(id_col).cast("long").alias("__key"), row)
    order = [F.col(f"__row.{id_col}").asc_nulls_first(), F.col("__rank"), F.col("__spread")]
    ranked = df.select(
        row, F.coalesce(F.sha2(F.col(rank_by).cast("binary"), 256), F.lit("")).alias("__rank"), F.monotonically_increasing_id().alias("__spread")
    )
    ranked = ranked.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranked.select(F.monotonically_increasing_id().alias("__key"), "__row"), "keyed")

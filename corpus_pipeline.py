"""From raw documents to encoded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of docs.

Defined cases, for every stage: null texts count as empty and stay null where they are
kept; nulls in other columns pass through; very long texts are worked on whole; rows that
repeat an id are documents of their own; columns of any name pass through; an empty table
gives an empty table. What a stage adds to this stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tokenweir.llm import mixing, pieces, quality, simhash, suffixdedup
from tokenweir.llm.common import materialize, packed_row, table, with_row_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and the trained verdict.

    Null and empty texts fail the base rules; without labels of both kinds these alone count;
    a probability of just the threshold keeps; equal rows get equal verdicts.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select("text", packed_row(docs)), model, ["__row"]).filter("kept").select("__row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest doc_id.

    Of rows that share it, or that have none, the one with the smallest SHA-256 of its text
    stays (equal rows: any one of them); texts without words are copies of one another.
    """
    keyed = with_row_key(docs, "doc_id")
    found = simhash.simhash_components(keyed.select(F.col("__key").alias("doc_id"), F.col("__row.text").alias("text")))
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return keyed.join(gone, F.col("__key") == F.col("__gone"), "left_anti").select("__row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from texts; a text may become empty, its row stays.

    The document with the smaller doc_id keeps a passage (ties as in the near-dedup);
    characters that are cut in two go whole; n_chars is counted anew, null texts have none.
    """
    cut = suffixdedup.remove_repeats(docs, as_text=True)
    text = F.when(F.col("__row.text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights.

    A null source is a source of its own and ranks last; rows that repeat an id share a coin.
    """
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with a check that they decode to its text; null and empty texts have none."""
    return pieces.encode_documents(docs, columns=["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The trained verdict and the encoder can't be said in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

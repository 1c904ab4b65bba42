import pytest
import sentencepiece
from helpers import PASSAGE, edge_docs, empty_docs, words
from pyspark.sql import functions as F
from test_quality import brute as brute_quality
from test_simhash import brute_components, brute_fp

from tokenweir.llm import pieces, suffixdedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")
LABELS = "doc_id long, quality int, toxic int"


def docs_for_stages(spark):
    rows = [(i, words(60 + i, i) + "\n" + (PASSAGE if i % 4 == 0 else "") + words(30, 500 + i), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(10)]
    rows += [(200 + i, " | ".join(words(80, 900 + i).split()), "en", "s2", 0) for i in range(25)]
    rows += [(300, "too short", "en", "s0", 0), (301, None, None, None, None), (302, "same words again " * 30, "en", "s0", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_against_brute_force(spark, tmp_path):
    docs = docs_for_stages(spark)
    labels = [(i, 1, 0) for i in range(30)] + [(200 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    one = kept.collect()
    assert {r.doc_id for r in one} == set(range(40)) | set(range(100, 110))
    assert all(brute_quality(r.text)[0] >= 20 for r in one)

    two = corpus_pipeline.simhash_near_dedup(spark, kept, str(tmp_path))
    ids = [r.doc_id for r in one]
    roots = brute_components([brute_fp(r.text) for r in one], ids)
    assert {r.doc_id for r in two.collect()} == {i for i, c in zip(ids, roots) if i == c}

    three = corpus_pipeline.suffix_dedup(spark, two, str(tmp_path))
    assert three.columns == docs.columns
    before = sorted(two.collect(), key=lambda r: r.doc_id)
    want = suffixdedup.brute_force([r.text.encode() for r in before])
    got = sorted(three.collect(), key=lambda r: r.doc_id)
    assert [r.text for r in got] == [w[0].decode("utf-8", "ignore") for w in want]
    assert all(r.n_chars == len(r.text) for r in got)

    four = corpus_pipeline.mix_sources(spark, three, str(tmp_path))
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in got}

    five = corpus_pipeline.encode_pieces(spark, four, str(tmp_path)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    text = {r.doc_id: r.text for r in got}
    assert len(five) == four.count()
    assert all(r.round_trip and r.piece_ids == library.encode(text[r.doc_id]) for r in five)

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_pieces) for r in whole) == sorted((r.doc_id, r.n_pieces) for r in five)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_edges(spark, tmp_path, k):
    spark.createDataFrame([(1, 1, 0), (9, None, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    docs = edge_docs(spark)
    out = stage(spark, docs, str(tmp_path))
    if k < 4:
        assert out.columns == docs.columns, name
    if k in (2, 4):
        assert out.count() == docs.count()
    if k == 1:
        texts = [r.text for r in out.collect()]
        assert len(texts) == len(set(texts)) and sum(1 for t in texts if not (t or "").split()) == 1
    assert stage(spark, empty_docs(spark), str(tmp_path)).count() == 0


def test_columns_with_inner_names_stay(spark, tmp_path):
    """Columns of the user that are named like those that operators make inside."""
    rows = [(1, "one text of some words", "mine1", 7), (2, "another text", "mine2", 8), (2, "another text", "mine3", 9), (None, None, "mine4", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, kept long").withColumns({"__row": F.col("__key"), "source": F.lit("s")})
    near = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    got = {r["__key"]: (r["__row"], r.kept) for r in near.collect()}
    assert got.keys() in ({"mine1", "mine2", "mine4"}, {"mine1", "mine3", "mine4"}) and all(k == v[0] for k, v in got.items())
    for stage in (corpus_pipeline.suffix_dedup, corpus_pipeline.mix_sources):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r["__key"] == r["__row"] for r in out.collect())
    assert corpus_pipeline.suffix_dedup(spark, docs, str(tmp_path)).count() == 4

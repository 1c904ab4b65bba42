import pytest
import sentencepiece
from helpers import edge_docs, empty_docs
from hypothesis import given, settings, strategies as st

from tokenweir.llm import pieces

MODEL = pieces.PieceModel(open(pieces.DEFAULT_MODEL, "rb").read())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aeiourstnl  \n\t.,-=0123éß日🙂▁'")), max_size=60), max_size=5))
def test_equals_the_library(texts):
    ids = MODEL.encode_all(texts)
    assert ids == [LIBRARY.encode(t) for t in texts]
    assert [MODEL.decode(x) for x in ids] == [t.replace("▁", " ") for t in texts]


def test_overflow_of_the_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 3)
    model = pieces.PieceModel(open(pieces.DEFAULT_MODEL, "rb").read())
    texts = ["one two three four five", "six seven one two", ""]
    assert model.encode_all(texts) == [LIBRARY.encode(t) for t in texts]


def test_documents(spark):
    docs = edge_docs(spark)
    got = pieces.encode_documents(docs, columns=["doc_id", "text", "score"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.round_trip and r.n_pieces == len(r.piece_ids)
        assert r.piece_ids == LIBRARY.encode(r.text or "")
    assert pieces.encode_documents(empty_docs(spark)).count() == 0


def test_scored_models_take_the_best_path():
    model = pieces.PieceModel(open(pieces.DEFAULT_MODEL, "rb").read())
    model.bpe, model.words = False, {}
    model.ids = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    model.scores = [-1.0, -1.0, -1.0, -2.5, -1.5]
    model.longest = 2
    assert model.encode_all(["ab"])[0] == [4, 2]  # -2.5 beats -3.0 and -3.5


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, IndexError)):
        pieces.PieceModel(b"\x0a\x03abc")


def with_kind(data, kind):
    """The model file with another model type (1 unigram, 2 BPE) and the same pieces and scores."""
    out = bytearray()

    def varint(n):
        b = bytearray()
        while n > 127:
            b.append(n & 127 | 128)
            n >>= 7
        return bytes([*b, n])

    for field, value in pieces._fields(data):
        if field == 2:
            spec = bytearray()
            for f, v in pieces._fields(value):
                v = kind if f == 3 else v
                if isinstance(v, int):
                    spec += varint(f << 3) + varint(v)
                else:
                    wire = 5 if len(v) == 4 and f in (10, 11) else 2
                    spec += varint(f << 3 | wire) + (b"" if wire == 5 else varint(len(v))) + v
            value = bytes(spec)
        out += varint(field << 3 | 2) + varint(len(value)) + value
    return bytes(out)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    path = tmp_path_factory.mktemp("models") / "unigram.model"
    path.write_bytes(with_kind(open(pieces.DEFAULT_MODEL, "rb").read(), 1))
    return str(path)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aeiourstnl  \n\t.,-=0123éß日🙂'")), max_size=60), max_size=5))
def test_viterbi_equals_the_library_on_a_unigram_model(unigram, texts):
    model = pieces._MODELS.setdefault(unigram, pieces.PieceModel(open(unigram, "rb").read()))
    library = sentencepiece.SentencePieceProcessor(model_file=unigram)
    assert not model.bpe
    ids = model.encode_all(texts)
    for t, x in zip(texts, ids):
        want = library.encode(t)
        assert sum(model.scores[k] for k in x if k not in model.bytes_.values()) == sum(model.scores[k] for k in want if k not in model.bytes_.values())
        assert x == want
        assert model.decode(x) == t


def test_two_models_in_one_worker(spark, unigram):
    """Files with the same last bytes are told apart."""
    docs = spark.createDataFrame([(1, "unbelievable tokenization of strangely hyphenated words")], "doc_id long, text string").coalesce(1)
    library = sentencepiece.SentencePieceProcessor(model_file=unigram)
    for _ in range(2):
        assert pieces.encode_documents(docs).first().piece_ids == LIBRARY.encode(docs.first().text)
        assert pieces.encode_documents(docs, unigram).first().piece_ids == library.encode(docs.first().text)
    assert LIBRARY.encode(docs.first().text) != library.encode(docs.first().text)

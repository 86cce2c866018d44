import numpy as np
import pytest
import sentencepiece

from loomsearch.llm import pieces

from .helpers import SMALL, documents, needs_tables

PATH = pieces.vocabulary_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "Hello world", " leading", "trailing ", "two  spaces   here", "new\nline\ttab", "naïve café İ ß", "\U0001f600 emoji \U0001f468‍\U0001f469", "中文 字符", "▁mark ▁▁ x▁y", "\x00\x01\x85 ", "a" * 3000, "word " * 9000,
    "<s> </s> <unk> <0x41>", "1234567890 3.14", "é", " nbsp", "antidisestablishmentarianism",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_are_those_of_the_library(library):
    codec = pieces.Pieces(PATH)
    texts = [t or "" for t in TEXTS]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids_of(ids) == library.encode(t), t[:50]
        assert codec.decode(ids) == library.decode(ids_of(ids)), t[:50]


@needs_tables
def test_ids_of_all_documents(spark, library):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    codec = pieces.Pieces(PATH)
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids_of(ids) == library.encode(t)


def test_walk_shares_states_and_agrees_with_merging():
    codec = pieces.Pieces(PATH)
    words = sorted(pieces.MARK + w for w in ("search searches searching searched sea seat seats a an and ant anti antic banana bananas".split()))
    assert dict(codec.walk(words)) == {w: codec.merged(w) for w in words}


def test_round_trip_operators(spark):
    docs = documents(spark, *TEXTS)
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encoded(docs, PATH), PATH).collect()}
    rows = {r["doc_id"]: r for r in pieces.round_trip(docs, PATH).collect()}
    for k, t in enumerate(TEXTS):
        assert rows[k]["same"] == (back[k] == (t or "")) and rows[k]["n_chars"] == len(back[k])
        if "▁" not in (t or ""):
            assert back[k] == (t or ""), t
    null = pieces.encoded(docs, PATH).selectExpr("doc_id", "CAST(NULL AS BINARY) AS ids").limit(1)
    assert pieces.decoded(null, PATH).first()["text"] == ""


def test_repeats_null_ids_and_empty(spark):
    docs = documents(spark, "one two", "one two", None, ids=[None, None, 3])
    assert pieces.round_trip(docs, PATH).count() == 3 and pieces.round_trip(docs.limit(0), PATH).count() == 0


@needs_tables
def test_query(spark):
    got = pieces.op8_sentencepiece(spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count() and got.where("NOT same").count() == 0

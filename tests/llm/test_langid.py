import random
import zlib

import pytest

from loomsearch.llm import langid

from .helpers import SMALL, documents, needs_tables

EN = "the quick brown fox jumps over the lazy dog and then the dog sleeps in the warm sun of the afternoon "
DE = "der schnelle braune fuchs springt über den faulen hund und dann schläft der hund in der warmen sonne "


def parse_length(known, text):
    """Phrases by plain search: the longest prefix that occurs in ``known``, again and again."""
    n = 0
    while text:
        k = 1
        while k < len(text) and text[: k + 1] in known:
            k += 1
        text, n = text[k:], n + 1
    return n


HIGH = "\U00010428\U00010429\U0001042a"  # letters above U+FFFF
PLAIN = ["the dog", "dog über fox", "zzz", "", "q", "the quick brown fox", "лес", "a" * 5000, (EN + DE) * 40, (DE * 3)[7:], HIGH * 900 + EN, "zq" * 3000 + EN * 30]


@pytest.mark.parametrize("stretch", [langid.STRETCH, 1, 2, 7, 64, 500, 10**6])
def test_phrases_against_plain_search(monkeypatch, stretch):
    """The counts are those of whole texts, wherever long ones are cut."""
    monkeypatch.setattr(langid, "STRETCH", stretch)
    known = {"de": DE, "en": EN + HIGH, "xx": "zqzqzq abab"}
    model = langid.Model(known)
    want = [[parse_length(known[x], t) for x in model.langs] for t in PLAIN]
    assert model.phrases(PLAIN).tolist() == want
    assert [model.phrases([t])[0].tolist() for t in PLAIN] == want


def test_phrases_of_random_texts(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        known = {x: "".join(rng.choices("ab c", k=rng.randint(1, 80))) for x in "xyz"}
        texts = ["".join(rng.choices("abcd ", k=rng.randint(0, 200))) for _ in range(6)]
        monkeypatch.setattr(langid, "STRETCH", rng.randint(1, 40))
        model = langid.Model(known)
        assert model.phrases(texts).tolist() == [[parse_length(known[x], t) for x in model.langs] for t in texts]


@needs_tables
def test_phrases_of_all_documents(spark):
    """The shipped stretch on the table's own texts: the same counts as without any cut."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.Model(langid.sample(docs))
    texts = [langid.letters_of(r["text"]) for r in docs.collect()]
    cut = model.phrases(texts)
    whole, langid.STRETCH = langid.STRETCH, 10**7
    try:
        assert max(map(len, texts)) > whole and (model.phrases(texts) == cut).all()
    finally:
        langid.STRETCH = whole


def test_shares():
    assert langid.shares([5, 100, 100], 65) == [5, 30, 30] and langid.shares([], 9) == [] and langid.shares([3, 3], 100) == [3, 3]


def test_predictions(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    test = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2][:6]
    docs = documents(spark, *[EN, DE] * 20, "the lazy fox sleeps", "der faule hund springt", None, "123 !?", "", "the lazy fox sleeps", ids=ids + test, lang=["en", "de"] * 20 + ["de", "en", "en", "en", None, "de"])
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert [got[i]["lang_pred"] for i in test] == ["en", "de", "und", "und", "und", "en"] and all(got[i]["held_out"] for i in test)
    assert not any(got[i]["held_out"] for i in ids) and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got) - set(test[2:5])


def test_labels_of_held_out_documents_do_not_matter(spark):
    ids = list(range(60))
    texts = [(EN if i % 2 else DE) for i in ids]
    lang = ["en" if i % 2 else "de" for i in ids]
    odd = ["xx" if zlib.crc32(str(i).encode()) % 4 == 2 else x for i, x in zip(ids, lang, strict=True)]
    one = langid.identify(documents(spark, *texts, lang=lang)).collect()
    assert sorted(one) == sorted(langid.identify(documents(spark, *texts, lang=odd)).collect())


def test_nothing_to_learn_null_ids_repeats_and_empty(spark):
    docs = documents(spark, "some words", None, "some words", ids=[None, 1, None])
    got = langid.identify(docs).collect()
    assert len(got) == 3 and {(r["lang_pred"], r["score"], r["held_out"]) for r in got} == {("und", 0.0, False)}
    assert langid.keep_known(docs).count() == 3
    assert langid.identify(docs.limit(0)).count() == 0 == langid.keep_known(docs.limit(0)).count()


@needs_tables
def test_held_out_accuracy(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = langid.op7_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert langid.keep_known(docs).count() >= 0.98 * docs.count()

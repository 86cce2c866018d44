import re

import duckdb
import pytest

from loomsearch.llm import licenses

from .helpers import SMALL, as_folder, documents, needs_tables

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(doc_id, text):
    words = WORD.findall(lower(text))
    places, base = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if base else 0.0
    low = lower(text)
    paragraphs = [p for p in re.split(r"\n[\x20\x09\x0D]*\n", low) if "\n" in p]
    for block in [*low.split("\n"), *paragraphs]:
        have = set(WORD.findall(block))
        for label, notice in licenses.TEMPLATES:
            want = set(WORD.findall(notice.lower()))
            if len(want & have) >= 0.8 * len(want) - 1e-9:
                labels.add(label)
                score = max(score, len(want & have) / len(want))
    return (doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 6))


TEXTS = [
    None, "", " \n\t", "MIT License", "mit  -- LICENSE and CC BY, Apache-License; GNU general\npublic license", "cc by cc by cc by", "smit license", "the mit licenses",
    "é cc by mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files\n\nother",
    "Permission is hereby granted to any person", "word " * 20000 + "apache license", "cc by", "cc by", licenses.TEMPLATES[1][1][:60],
]


def test_edges_against_brute_force(spark):
    docs = documents(spark, *TEXTS)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in licenses.scan(docs, licenses.token_order(docs)).collect()}
    assert got == {k: brute(k, t) for k, t in enumerate(TEXTS)}


def test_order_does_not_change_matches(spark):
    docs = documents(spark, *TEXTS)
    one = licenses.scan(docs, licenses.token_order(docs)).collect()
    two = licenses.scan(docs, sorted(licenses.vocabulary(), reverse=True)).collect()
    assert sorted(one) == sorted(two)


def test_empty_table_and_repeated_rows(spark):
    docs = documents(spark, "mit license", "mit license", ids=[1, 1])
    assert licenses.scan(docs.limit(0), licenses.token_order(docs.limit(0))).count() == 0
    assert licenses.scan(docs, licenses.token_order(docs)).count() == 2
    nulls = documents(spark, "mit license", ids=[None])
    assert licenses.scan(nulls, licenses.token_order(nulls)).first()["n_base"] == 1


@needs_tables
def test_query_against_brute_force_and_sql(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in licenses.op1_license_scan(spark, SMALL).collect()}
    assert got == {r["doc_id"]: brute(r["doc_id"], r["text"]) for r in docs.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = con.execute(licenses.oracle())
    names = [d[0] for d in found.description]
    assert {r[names.index("doc_id")]: tuple(r[names.index(c)] for c in COLUMNS) for r in found.fetchall()} == got


def test_needed_is_a_ceiling():
    assert [licenses.needed(n) for n in (1, 2, 4, 5, 10)] == [1, 2, 4, 4, 8]
    assert licenses.needed(10, 0.71) == 8


@pytest.mark.parametrize("label", sorted({x for x, _ in licenses.TEMPLATES}))
def test_every_notice_is_found(spark, label):
    notices = [n for x, n in licenses.TEMPLATES if x == label]
    docs = documents(spark, *[f"before\n{n}\nafter" for n in notices])
    assert all(label in r["labels"].split(",") for r in licenses.scan(docs, licenses.token_order(docs)).collect())


def test_query_reads_a_folder(spark, tmp_path):
    assert licenses.op1_license_scan(spark, as_folder(tmp_path, documents=documents(spark, "cc by"))).count() == 1

"""Queries on tables that the small test tables do not cover, against their SQL."""

from dataclasses import replace

import duckdb
import pytest

from loomsearch import queries

from .test_queries import plain


@pytest.fixture
def same(spark, tmp_path):
    """Checks a query against its SQL on one table of the given rows."""

    def check(name: str, table: str, rows: list[tuple], schema: str) -> list[tuple]:
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
        df = queries.queries()[name](spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        found = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in found.description]
        got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
        assert got == sorted(tuple(plain(v) for v in r) for r in found.fetchall())
        return got

    return check


def test_links_of_pages_with_one_url(same):
    html = '<p><a href="/x">x</a> <a href="https://b.org/y">y</a></p>'
    rows = [(1, "https://a.org/p", html), (2, "https://a.org/p", html + '<a href="/z">z</a>'), (3, "https://a.org/q", html)]
    assert len(same("link_extract", "pages", rows, "page_id long, url string, html string")) == 5


def test_phrases_are_the_runs_of_the_tokens(spark):
    from collections import Counter

    from loomsearch.functions.text import tokenize
    from loomsearch.operators.index import index_stats, phrase_stats

    texts = ["The Go-Search engine, a b İx naïve", "", None, "Kelvin go", "end", "start of the x1 Y2 zz", "İİ", "a", "De De De De De", "é", "go\nsearch\tengine"]
    schema = "id string, title string, description string, content string"
    plain = spark.createDataFrame([(str(k), t, None, texts[-k]) for k, t in enumerate(texts)], schema)
    docs = plain.withColumn("terms", tokenize(plain["content"]))
    want = Counter()
    for row in plain.select(tokenize(plain["title"]), tokenize(plain["content"])).collect():
        for t in row:
            want.update(" ".join(t[i : i + n]) for n in (2, 3, 4) for i in range(len(t or []) - n + 1))
    assert {r["phrase"]: r["freq"] for r in phrase_stats(docs).collect()} == want and want["de de"] == 8
    assert {r["phrase"] for r in phrase_stats(docs, "go se").collect()} == {p for p in want if p.startswith("go se")}
    assert index_stats(docs).first()["phrases"] == len(want)
    assert "explode" not in phrase_stats(docs)._jdf.queryExecution().executedPlan().toString()  # no row for each phrase before the exchange


def test_texts_are_not_exchanged_for_scores(spark):
    from loomsearch.operators import index

    from .fixtures import doc, frame

    docs = [doc("1", "go search"), doc("2", "go go notes here"), doc("3", "other")]
    idx = index.Index.of(frame(spark, *docs))
    rows = index.scored(idx, ["go", "go", "search"])
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    twice = index.Index.of(frame(spark, *docs, docs[0]))  # an id that repeats, as before
    got = {r["id"]: r["base_score"] for r in rows.collect()}
    for same in (replace(idx, stored=True), idx):
        assert {r["id"]: pytest.approx(r["score"]) for r in index.bm25(same, ["go", "go", "search"]).collect()} == got
    assert not twice.unique and index.scored(twice, ["search"]).count() == 2


def test_a_page_is_compared_without_a_second_search(spark):
    plan = queries.compare_card(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # one for the counts of the corpus, one for the scores

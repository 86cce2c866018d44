import math

from pyspark.sql import functions as F

from loomsearch.functions import text
from loomsearch.operators import index, ingest, suggest

from .fixtures import doc, frame


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_tokenize_and_ngrams(spark):
    df = spark.createDataFrame([("The Go-Search engine, a b İx naïve",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.tokenize(F.col("t"))).collect()]
    assert got == [["go", "search", "engine", "ix", "na", "ve"], [], None]
    grams = df.limit(1).select(text.ngrams(text.tokenize(F.col("t")), 2, 3)).first()[0]
    assert grams[:2] == ["go search", "search engine"] and "go search engine" in grams and len(grams) == 5 + 4


def test_postings_and_upsert(spark):
    docs = frame(spark, doc("1", "go go search"))
    assert values(index.postings(docs), "term", "tf") == [("go", 2), ("search", 1)]
    again = index.upsert(docs, frame(spark, doc("1", "concurrency")))
    assert values(index.postings(again), "term", "tf") == [("concurrency", 1)]
    assert again.count() == 1


def test_bm25_by_hand(spark):
    docs = frame(spark, doc("1", "go search"), doc("2", "go go notes here"), doc("3", "other"), doc("4", "", terms=""))
    idx = index.Index.of(docs)
    got = dict(values(index.bm25(idx, ["go"]), "id", "score"))
    n, df, avg = 4, 2, (2 + 4 + 1 + 0) / 4
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    by_hand = lambda tf, dl: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert math.isclose(got["1"], by_hand(1, 2)) and math.isclose(got["2"], by_hand(2, 4)) and set(got) == {"1", "2"}
    twice = dict(values(index.bm25(idx, ["go", "go"]), "id", "score"))
    assert math.isclose(twice["1"], 2 * got["1"])
    assert index.bm25(idx, []).count() == 0


def test_index_survives_a_round_trip(spark, tmp_path):
    docs = frame(spark, doc("1", "go search"), doc("2", "go notes"))
    idx = index.Index.of(docs).write(str(tmp_path / "index"))
    assert values(index.bm25(idx, ["search"]), "id") == [("1",)]


def test_stats(spark):
    docs = frame(spark, doc("1", "go search engine"), doc("2", "go search"))
    assert values(index.term_stats(docs), "term", "df") == [("engine", 1), ("go", 2), ("search", 2)]
    assert values(index.phrase_stats(docs), "phrase", "freq") == [("go search", 2), ("go search engine", 1), ("search engine", 1)]
    assert index.index_stats(docs).first().asDict() == {"documents": 2, "terms": 3, "phrases": 3}


def test_completions(spark):
    docs = frame(spark, doc("1", "go search engine"), doc("2", "go search notes"), doc("3", "security search"))
    terms, phrases = index.term_stats(docs), index.phrase_stats(docs)
    one = [r["value"] for r in suggest.completions(terms, phrases, "Se", 10).collect()]
    assert one[:2] == ["search", "security"] and "search engine" in one[2:]
    many = [r["value"] for r in suggest.completions(terms, phrases, "go se", 10).collect()]
    assert many == ["go search engine", "go search notes"] or many[0].startswith("go search")
    assert suggest.completions(terms, phrases, " ", 10).count() == 0


def test_spelling(spark):
    docs = frame(spark, doc("1", "premium search"))
    terms = index.term_stats(docs)
    assert suggest.correct(terms, "premum searh") == "premium search"
    assert suggest.correct(terms, "unrelatedword") == "unrelatedword"
    assert suggest.correct(terms, " The ") == "the"


def test_duplicates_and_first_in_batch(spark):
    store = frame(spark, doc("s", "x", fingerprint="f0"))
    batch = frame(spark, doc("a", "x", fingerprint="f1"), doc("b", "x", fingerprint="f1"), doc("c", "x", fingerprint="f0"), doc("d", "x", fingerprint=""), doc("e", "x", fingerprint="")).withColumn("seq", F.ascii("id"))
    got = {r["id"]: r["canonical_url"] for r in ingest.duplicates(batch, store).collect()}
    assert got == {"b": "https://example.com/a", "c": "https://example.com/s"}
    assert values(ingest.accepted(batch, store), "id") == [("a",), ("d",), ("e",)]


def test_upsert_keeps_the_last(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("m", 1, "only")], "k string, seq int, v string")
    assert values(ingest.latest(rows, "k", F.col("seq")), "k", "v") == [("k", "new"), ("m", "only")]
    nulls = spark.createDataFrame([("k", None, "undated"), ("k", 1, "dated"), (None, None, "no key")], "k string, seq int, v string")
    got = ingest.latest(nulls, "k", F.col("seq"))
    assert got.columns == ["k", "seq", "v"] and sorted(r["v"] for r in got.collect()) == ["dated", "no key"]


def test_blocked_by_robots(spark):
    urls = spark.createDataFrame([("u1", "h", "/private/x"), ("u2", "h", "/open"), ("u3", "h", ""), ("u4", "g", "/private")], "url string, host string, path string")
    rules = spark.createDataFrame([("h", "/private"), ("h", "")], "host string, disallow string")
    assert values(ingest.blocked(urls, rules), "url") == [("u1",)]
    everything = spark.createDataFrame([("h", "/")], "host string, disallow string")
    assert values(ingest.blocked(urls, everything), "url") == [("u1",), ("u2",), ("u3",)]


def test_expansion_is_capped_and_unique(spark):
    roots = spark.createDataFrame([("https://a.org/", 0), ("https://b.org/", 1)], "root string, root_pos int")
    found = spark.createDataFrame([("https://a.org/", i, f"https://a.org/{i}") for i in range(40)] + [("https://b.org/", 0, "https://a.org/1")], "root string, pos int, url string")
    got = ingest.expanded(roots, found)
    assert got.where("root = 'https://a.org/'").count() == 25
    assert got.where("url = 'https://a.org/1'").first()["root"] == "https://a.org/"
    assert got.where("not discovered").count() == 2

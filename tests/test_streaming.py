import json

from pyspark.sql import functions as F

import pytest
from pyspark.errors import StreamingQueryException

from loomsearch.operators import log
from loomsearch.sources import pages
from loomsearch.sources.stores import ParquetStore
from loomsearch.streaming import crawl

from .fixtures import NOW, doc, frame


def test_crawl_queue(spark, tmp_path):
    requests, jobs = tmp_path / "requests", tmp_path / "jobs"
    requests.mkdir()
    store = ParquetStore(spark, str(tmp_path / "store"))
    to_documents = lambda df: pages.documents(df.select("url", "html"), F.lit(NOW))

    def send(name, rows):
        (requests / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
        q = crawl.ingest(spark, str(requests), store, str(jobs), str(tmp_path / "checkpoint"), to_documents)
        q.awaitTermination(120)

    at = "2026-04-20T12:00:00Z"
    send("one", [{"job_id": "crawl-1", "url": "https://a.org/1", "html": "<title>T</title>same", "requested_at": at}, {"job_id": "crawl-1", "url": "https://a.org/2", "html": "", "requested_at": at}])
    assert [r["url"] for r in store.scan().collect()] == ["https://a.org/1"]
    send("two", [{"job_id": "crawl-2", "url": "https://a.org/3", "html": "<title>T</title>same", "requested_at": at}, {"job_id": "crawl-2", "url": "https://a.org/4", "html": "<title>U</title>other", "requested_at": at}])
    assert sorted(r["url"] for r in store.scan().collect()) == ["https://a.org/1", "https://a.org/4"]
    rows = {r["job_id"]: r for r in spark.read.json(str(jobs)).collect()}
    assert rows["crawl-1"]["status"] == "completed" and rows["crawl-1"]["issues"] == 1 and rows["crawl-2"]["duplicates"] == 1


def test_a_failing_batch_is_a_failed_job(spark, tmp_path):
    requests, jobs = tmp_path / "requests", tmp_path / "jobs"
    requests.mkdir()
    (requests / "one.json").write_text(json.dumps({"job_id": "crawl-1", "url": "u", "html": "x", "requested_at": "2026-04-20T12:00:00Z"}))

    def broken(df):
        raise RuntimeError("store is gone")

    stream = crawl.ingest(spark, str(requests), ParquetStore(spark, str(tmp_path / "s")), str(jobs), str(tmp_path / "c"), broken)
    with pytest.raises(StreamingQueryException):  # the checkpoint repeats the batch, so that its pages are not lost
        stream.awaitTermination(120)
    row = spark.read.json(str(jobs)).first()
    assert row["status"] == "failed" and "gone" in row["error"]


def test_rolling_terms(spark, tmp_path):
    docs = frame(spark, doc("1", "go search"), doc("2", "go notes"))
    docs.write.parquet(str(tmp_path / "in"))
    q = crawl.rolling_terms(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "c"), str(tmp_path / "out"))
    q.awaitTermination(120)
    assert q.exception() is None


def test_ttl_replay(spark):
    rows = [("k", 0), ("k", 60), ("k", 121), ("k", 240), ("j", 50)]
    df = spark.createDataFrame(rows, "key string, s long").select("key", F.timestamp_seconds("s").alias("at"))
    got = [(r["key"], r["hit"]) for r in log.replay(df, 120).orderBy("key", "at").collect()]
    assert got == [("j", False), ("k", False), ("k", True), ("k", False), ("k", True)]


def test_log_analytics(spark):
    rows = [("Go ", 10, False, 1), ("go", -5, True, 2), ("", 4, False, 3)]
    df = spark.createDataFrame(rows, "query string, latency_ms long, cache_hit boolean, s long").select("query", "latency_ms", "cache_hit", F.timestamp_seconds("s").alias("at"))
    row = log.analytics(df).first()
    assert (row["total_queries"], row["cache_hits"], row["average_ms"], row["last_latency_ms"]) == (3, 1, round(14 / 3, 6), 4)
    assert [tuple(r) for r in log.top_queries(df).collect()] == [("go", 2)]
    assert log.analytics(df.limit(0)).first()["cache_hit_rate"] == 0

"""Documents of the model from a ``documents`` table (doc_id, text, lang, source): urls, titles, links and times follow from the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import fingerprint, host, tokenize
from .operators.ingest import recrawl_after

AS_OF = "2024-01-31 00:00:00"
SITES = 58


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def url_of(k: Column) -> Column:
    n, site = k.cast("string"), (k % SITES).cast("string")
    kind = k % 4
    return (
        F.when(kind == 0, F.concat(F.lit("https://www.site"), site, F.lit(".example.org/docs/"), n, F.lit(".pdf")))
        .when(kind == 1, F.concat(F.lit("https://news.site"), site, F.lit(".example.com/a/"), n))
        .when(kind == 2, F.concat(F.lit("http://site"), site, F.lit(".example.gov/v1.2/"), n, F.lit(".html")))
        .otherwise(F.concat(F.lit("http://localhost/p/"), n))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    k = F.col("doc_id")
    lines = F.split("content", "\n", 5)  # four lines are shown of; the rest stays together
    df = raw.withColumns({
        "id": F.lpad(k.cast("string"), 10, "0"),
        "url": url_of(k),
        "title": F.substring(F.get(lines, F.lit(0)), 1, 80),
        "description": F.when(k % 5 == 0, "").otherwise(F.concat_ws(" ", F.substring(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), 1, 120), "source")),
        "headings": F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.slice(lines, 1, 4), lambda x: F.substring(x, 1, 60))),
        "links": F.array(url_of(F.floor(k / 2)), url_of((k * 7 + 3) % 997)),
        "crawled_at": F.when(k % 41 != 0, as_of() - F.make_dt_interval(days=(k % 60).cast("int"), hours=(k % 24).cast("int"))),
    })
    df = df.withColumns({"domain": host(F.col("url")), "terms": tokenize(F.concat_ws(" ", "title", "description", "content")), "content_fingerprint": fingerprint(F.col("title"), F.col("description"), F.col("content"))})
    df = df.withColumn("recrawl_after", recrawl_after(F.col("crawled_at")))
    return df.select("id", "url", "domain", "title", "description", "content", "terms", "links", "headings", "content_fingerprint", "crawled_at", "recrawl_after")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a query log: type as query, value as latency, every third a cache hit."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("query"), F.floor("value").cast("long").alias("latency_ms"), (F.col("event_id") % 3 == 0).alias("cache_hit"), F.col("ts").alias("at"), "event_id", "user_id")

"""Pages from the web: bounded parallel requests in tasks, with robots rules and sitemaps applied before them."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import blocked
from ..plans.lineage import cut
from .crawling import ROBOTS_CHARS, SITEMAP_CHARS, rules, rules_for, sitemap_entries, unreadable
from .pages import documents

#: Bytes of a page that are read, seconds that a request may take, and requests at a time.
PAGE_BYTES, SECONDS, PARALLEL = 2 << 20, 10, 4
ORIGIN = r"^(?i)(https?://[^/?#]+)"


def get(url: str, user_agent: str, most: int = PAGE_BYTES) -> tuple[int | None, str, str]:
    """(status, body, error) of one GET request; the body is cut at ``most`` bytes."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": user_agent})
        if request.type not in ("http", "https"):
            return None, "", f"unsupported scheme {request.type}"
        with urllib.request.urlopen(request, timeout=SECONDS) as response:
            charset = response.headers.get_content_charset() or "utf-8"
            body = response.read(most)
        try:
            return response.status, body.decode(charset, "replace"), ""
        except LookupError:
            return response.status, body.decode("utf-8", "replace"), ""
    except urllib.error.HTTPError as e:
        return e.code, "", f"unexpected status {e.code}"
    except (OSError, ValueError) as e:
        return None, "", f"fetch url: {e}"


def responses(urls: DataFrame, user_agent: str, most: int = PAGE_BYTES, parallel: int = PARALLEL) -> DataFrame:
    """(url, status, body, error) of each row; written once, so that no request is repeated by a later step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["url"]:
                yield pd.DataFrame([(url, *get(url, user_agent, most))], columns=["url", "status", "body", "error"]).astype({"status": "Int64"})

    return cut(urls.select("url").repartition(parallel).mapInPandas(run, "url string, status long, body string, error string"))


def admitted(urls: DataFrame, robots: DataFrame, user_agent: str) -> tuple[DataFrame, DataFrame]:
    """The urls that may be fetched, and (url, error) of the others, from robots files (host, body, status)."""
    rows = urls.select("url", F.regexp_extract("url", ORIGIN, 1).alias("host"), F.regexp_replace(F.regexp_replace("url", ORIGIN, ""), "[?#].*$", "").alias("path"))
    failed = rows.join(unreadable(robots), "host").select("url", "error")
    forbidden = blocked(rows, rules_for(rules(robots), user_agent)).select("url", F.lit("blocked by robots.txt").alias("error"))
    issues = failed.unionByName(forbidden).groupBy("url").agg(F.min("error").alias("error"))
    return urls.join(issues, "url", "left_anti"), issues


def robots_files(urls: DataFrame, user_agent: str) -> DataFrame:
    """(host, body, status) of each origin, asked once."""
    origins = urls.select(F.regexp_extract("url", ORIGIN, 1).alias("host")).where("host <> ''").distinct()
    got = responses(origins.select(F.concat("host", F.lit("/robots.txt")).alias("url")), user_agent, ROBOTS_CHARS)
    return got.select(F.expr("substring(url, 1, length(url) - length('/robots.txt'))").alias("host"), "body", "status")


def fetcher(spark: SparkSession, user_agent: str, now: Callable[[], Column] = F.current_timestamp) -> Callable[[list[str]], DataFrame]:
    """What an engine calls to fetch urls: documents with a column ``error``, where the other columns of failed pages are null."""

    def fetch(urls: list[str]) -> DataFrame:
        asked = spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "url string")
        fine, issues = admitted(asked, robots_files(asked, user_agent), user_agent)
        got = responses(fine, user_agent)
        docs = documents(got.where("error = ''").select("url", F.col("body").alias("html")), now())
        failed = issues.unionByName(got.where("error <> ''").select("url", "error"))
        return docs.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)

    return fetch


def discoverer(spark: SparkSession, user_agent: str) -> Callable[[list[str]], DataFrame]:
    """What an engine calls to find more urls: (root, pos, url) from the sitemaps of roots without a path."""

    def discover(urls: list[str]) -> DataFrame:
        roots = spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "root string").where(F.col("root").rlike(r"^https?://[^/?#]+/?$"))
        asked = roots.select("root", F.concat(F.regexp_extract("root", ORIGIN, 1), F.lit("/sitemap.xml")).alias("url"))
        got = responses(asked.select("url").distinct(), user_agent, SITEMAP_CHARS).where("error = ''")
        return sitemap_entries(asked.join(got, "url").select("root", F.col("body").alias("xml")))

    return discover

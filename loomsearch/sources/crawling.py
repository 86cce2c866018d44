"""Robots rules and sitemaps as tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROBOTS_CHARS, SITEMAP_CHARS = 256 << 10, 512 << 10


def robots_rules(body: str) -> list[tuple[str, str]]:
    """(agent, disallow) pairs; each agent line starts its own group, and what comes before the first is for all agents."""
    agent, out = "*", []
    for line in body[:ROBOTS_CHARS].splitlines():
        name, colon, value = line.strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or line.strip().startswith("#"):
            continue
        if name == "user-agent":
            agent = value.lower()
            out.append((agent, ""))
        elif name == "disallow" and value:
            out.append((agent, value))
    return out


def rules(robots: DataFrame) -> DataFrame:
    """(host, agent, disallow) from robots files (host, body, status); a missing file (404) allows all, for others see ``unreadable``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, a, d) for h, b in zip(pdf["host"], pdf["body"], strict=True) for a, d in robots_rules(b or "")]
            yield pd.DataFrame(rows, columns=["host", "agent", "disallow"])

    return robots.where("status < 400").select("host", "body").mapInPandas(run, "host string, agent string, disallow string")


def unreadable(robots: DataFrame) -> DataFrame:
    """(host, error) of the hosts whose robots file could not be had, so that nothing of theirs may be fetched."""
    status = F.concat(F.lit("robots.txt: unexpected status "), F.col("status").cast("string"))
    failed = robots.where("status IS NULL OR status >= 400 AND status <> 404")
    return failed.select("host", F.when(F.col("status").isNull(), F.lit("robots.txt: no answer")).otherwise(status).alias("error"))


def rules_for(all_rules: DataFrame, user_agent: str) -> DataFrame:
    """(host, disallow) of the group that fits: the exact agent, else the longest one inside the name, else ``*``."""
    name = user_agent.lower()
    rank = F.when(F.col("agent") == name, 0).when((F.col("agent") != "*") & (F.col("agent") != "") & F.lit(name).contains(F.col("agent")), 1).when(F.col("agent") == "*", 2)
    fit = all_rules.withColumn("rank", rank).where("rank is not null")
    best = fit.groupBy("host").agg(F.min(F.struct("rank", (-F.length("agent")).alias("size"), "agent")).alias("b")).select("host", F.col("b.agent").alias("agent"))
    return fit.join(best, ["host", "agent"]).where("disallow <> ''").select("host", "disallow")


def sitemap_urls(root: str, xml: str) -> list[str]:
    """Absolute locations of a sitemap, or of an index, whose entries count as pages."""
    try:
        tree = ET.fromstring(xml[:SITEMAP_CHARS])
    except ET.ParseError:
        return []
    for kind in ("url", "sitemap"):
        found = [loc.text.strip() for node in tree.iter() if node.tag.rpartition("}")[2] == kind for loc in node if loc.tag.rpartition("}")[2] == "loc" and loc.text and loc.text.strip()]
        if found:
            return [urljoin(root, x) for x in found]
    return []


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(root, pos, url) from sitemaps (root, xml); only roots without a path are looked into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, i, u) for r, x in zip(pdf["root"], pdf["xml"], strict=True) if urlsplit(r).path in ("", "/") for i, u in enumerate(sitemap_urls(r, x or ""))]
            yield pd.DataFrame(rows, columns=["root", "pos", "url"])

    return sitemaps.select("root", "xml").mapInPandas(run, "root string, pos int, url string")

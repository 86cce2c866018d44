"""Documents from raw pages: an Arrow function around the standard HTML parser.

Defined results: a null or empty page has empty parts; a first title,
description or canonical link that is empty gives way to a later one; markup
that the parser does not take gives its text without tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint, host, tokenize
from ..operators.ingest import recrawl_after

SKIPPED = frozenset("script style noscript svg canvas iframe nav footer aside form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LIST_ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}, "dd": {"dt", "dd"}, "dt": {"dt", "dd"}}
PARTS = "title string, description string, canonical string, content string, headings array<string>, links array<string>"


def absolute(base: str, ref: str, keep_fragment: bool = False) -> str:
    try:
        full = urljoin(base, ref.strip())
        return full if keep_fragment else urldefrag(full)[0]
    except ValueError:
        return ""


class Parts(HTMLParser):
    """Title, description, headings, canonical url, visible text and links of one page."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.stack, self.skipped = base, [], 0
        self.title = self.description = self.canonical = None
        self.text: list[str] = []
        self.headings: list[str] = []
        self.links: list[str] = []
        self.held: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k.lower(): v or "" for k, v in reversed(attrs)}
        if tag == "meta" and not self.description and (a.get("name", "").lower() == "description" or a.get("property", "").lower() == "og:description"):
            self.description = " ".join(a.get("content", "").split())
        elif tag == "link" and not self.canonical and a.get("rel", "").strip().lower() == "canonical" and a.get("href", "").strip():
            self.canonical = absolute(self.base, a["href"])
        elif tag == "a" and a.get("href", "").strip():
            full = absolute(self.base, a["href"], keep_fragment=True)
            if urlsplit(full).scheme in ("http", "https"):
                self.links.append(full)
        if tag in VOID:
            return
        while self.stack and self.stack[-1] in LIST_ENDS.get(tag, ()):
            self.handle_endtag(self.stack[-1])
        self.stack.append(tag)
        self.skipped += tag in SKIPPED
        if tag == "title" and not self.title or tag in ("h1", "h2", "h3"):
            self.held.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            t = self.stack.pop()
            self.skipped -= t in SKIPPED
            if self.held and self.held[-1][0] == t:
                _, parts = self.held.pop()
                words = " ".join(unescape(" ".join(parts)).split())
                if t == "title":
                    self.title = self.title or words
                elif words and words not in self.headings:
                    self.headings.append(words)
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        for _, parts in self.held:
            parts.append(data)
        if not self.skipped and data.strip():
            self.text.append(" ".join(unescape(data).split()))


def parts_of(html: str | None, url: str | None) -> tuple:
    p, html = Parts(url or ""), (html or "").encode(errors="ignore").decode()
    try:
        p.feed(html)
        p.close()
    except (AssertionError, ValueError):  # markup that the parser does not take: its text without tags
        return "", "", "", " ".join(re.sub("<[^>]*>", " ", html).split()), [], list(dict.fromkeys(p.links))
    while p.stack:
        p.handle_endtag(p.stack[-1])
    return p.title or "", p.description or "", p.canonical or "", " ".join(p.text), p.headings, list(dict.fromkeys(p.links))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html) as (url, title, description, canonical, content, headings, links)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0] for x in PARTS.split(", ")]
        for pdf in batches:
            rows = [parts_of(h, u) for u, h in zip(pdf["url"], pdf["html"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "url", pdf["url"].to_numpy())
            yield out

    return pages.select("url", "html").mapInPandas(run, f"url string, {PARTS}")


def documents(pages: DataFrame, fetched_at: Column) -> DataFrame:
    """Documents of the model from raw pages; the title falls back to the requested url, the canonical url replaces it."""
    parts = extract(pages)
    title = F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title"))
    df = parts.select(F.when(F.col("canonical") != "", F.col("canonical")).otherwise(F.col("url")).alias("url"), title.alias("title"), "description", "content", "links", "headings")
    df = df.withColumns({"id": F.sha1(F.col("url")), "domain": host(F.col("url")), "content_fingerprint": fingerprint(F.col("title"), F.col("description"), F.col("content")), "terms": tokenize(F.concat_ws(" ", "title", "description", "content")), "crawled_at": fetched_at})
    df = df.withColumn("recrawl_after", recrawl_after(F.col("crawled_at")))
    return df.select("id", "url", "domain", "title", "description", "content", "terms", "links", "headings", "content_fingerprint", "crawled_at", "recrawl_after")


def strip_tags(html: Column) -> Column:
    """Text of markup that no parser takes."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))

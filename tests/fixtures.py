"""Small documents for the engine's tests."""

from datetime import datetime, timedelta, timezone

from loomsearch.plans.query import tokens
from loomsearch.schema import DOCUMENT

NOW = datetime(2026, 4, 20, 12, tzinfo=timezone.utc)


def doc(id: str, title: str, content: str = "", *, url: str = "", description: str = "", headings=(), links=(), age: timedelta | None = timedelta(0), recrawl: timedelta | None = None, fingerprint: str = "", terms: str | None = None) -> dict:
    url = url or f"https://example.com/{id}"
    host = url.split("/")[2].split(":")[0]
    return {
        "id": id, "url": url, "domain": host, "title": title, "description": description, "content": content, "terms": tokens(f"{title} {description} {content}" if terms is None else terms),
        "links": list(links), "headings": list(headings), "content_fingerprint": fingerprint, "crawled_at": None if age is None else NOW - age, "recrawl_after": None if recrawl is None else NOW + recrawl,
    }


def frame(spark, *docs: dict):
    return spark.createDataFrame([tuple(d[f.name] for f in DOCUMENT) for d in docs], DOCUMENT)

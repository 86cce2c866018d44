"""The engine's routes as a WSGI application, and a server for it; the routes and the names in what they say are fixed values."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from datetime import datetime
from pathlib import Path
from socketserver import ThreadingMixIn
from urllib.parse import parse_qs
from wsgiref.simple_server import WSGIRequestHandler, WSGIServer, make_server

from pyspark.sql import Row

from .config import Config
from .engine import Crawl, Engine, Job
from .plans.search import Response

BODY_BYTES = 1 << 20
#: Headers of every response.
HEADERS = [
    ("Content-Type", "application/json"),
    ("X-Content-Type-Options", "nosniff"),
    ("X-Frame-Options", "DENY"),
    ("Referrer-Policy", "strict-origin-when-cross-origin"),
    ("Cross-Origin-Opener-Policy", "same-origin"),
    ("Content-Security-Policy", "default-src 'self'; object-src 'none'; base-uri 'self'; frame-ancestors 'none'"),
]
REASONS = {200: "OK", 201: "Created", 202: "Accepted", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed", 500: "Internal Server Error", 502: "Bad Gateway"}


class Refused(Exception):
    def __init__(self, status: int, why: str) -> None:
        super().__init__(why)
        self.status = status


def plain(x):
    """Rows, times and nested values as JSON has them."""
    if isinstance(x, Row):
        x = x.asDict()
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x.isoformat() if isinstance(x, datetime) else x


def number(given: dict, name: str, otherwise: int) -> int:
    try:
        return int(given.get(name, otherwise))
    except ValueError:
        return otherwise


def result(r: Row) -> dict:
    signals = {"base_score": r["base_score"], "authority_boost": r["authority_boost"], "heading_match_boost": r["heading_boost"], "title_match_boost": r["title_boost"], "exact_phrase_boost": r["phrase_boost"], "description_boost": r["description_boost"], "freshness_boost": r["freshness_boost"], "combined_score_hint": r["score"]}
    return {"document_id": r["id"], "signals": signals} | {n: r[n] for n in ("url", "domain", "file_type", "title", "snippet", "site_links", "match_context", "score", "description", "crawled_at", "recrawl_after", "trust", "explanations")}


def response(out: Response, took_ms: int) -> dict:
    """A response with its tables; only the page and summaries come to the driver."""
    o = out.options
    said = {"query": out.query, "normalized_query": out.normalized_query, "corrected_query": out.corrected_query, "interpretation": out.interpretation, "count": out.count, "has_more": out.has_more, "cached": out.cached, "answer": out.answer, "results": [], "sort_by": o.sort_by, "min_trust": o.min_trust, "domain": o.domain, "trusted_only": o.trusted_only, "limit": out.limit, "offset": o.offset, "took_ms": took_ms}
    if out.page is None:
        return said
    rows = {name: df.collect() for name, df in out.tables.items()}
    said["results"] = [result(r) for r in out.page.orderBy("pos").collect()]
    said["quality"] = rows["quality"][0].asDict() | {"highlights": [r["highlight"] for r in rows["highlights"]]}
    said["related_queries"] = [r["phrase"] for r in rows["related"]]
    said["domains"] = rows["domains"]
    said["coverage"] = [{"domain": r["domain"], "count": r["count"], "avg_trust": r["average_trust"], "best_title": r["top_title"]} for r in rows["coverage"]]
    said["timeline"] = [{"label": r["bucket"], "count": r["count"]} for r in rows["timeline"]]
    said["compare"] = {"items": rows["compare"]} if rows["compare"] else None
    return said


def crawled(c: Crawl | None) -> dict:
    if c is None:
        return {"documents": [], "issues": [], "duplicates": [], "discovered": []}
    duplicates = [{"url": r["url"], "canonical_url": r["canonical_url"], "document_id": r["id"]} for r in c.duplicates.collect()]
    return {"documents": c.documents.drop("terms").collect(), "issues": c.issues.collect(), "duplicates": duplicates, "discovered": c.discovered}


def job_of(j: Job) -> dict:
    return {"id": j.job_id, "status": j.status, "urls": j.urls, "error": j.error, "response": crawled(j.crawl), "created_at": j.created_at, "started_at": j.started_at, "completed_at": j.finished_at}


class Api:
    """The application; with ``web_root``, the page ``index.html`` of that folder is served at the root."""

    def __init__(self, engine: Engine, web_root: str | None = None) -> None:
        self.engine, self.web_root = engine, web_root
        self.routes: list[tuple[str, str, Callable]] = [
            ("GET", "/healthz", lambda q, b: (200, {"status": "ok", "stats": engine.stats()})),
            ("GET", "/readyz", lambda q, b: (200, {"status": "ready"} | {k: v for k, v in engine.stats().items() if k in ("documents", "stale_documents", "crawl_jobs", "deduplicated_urls")})),
            ("GET", "/api/v1/analytics", self.analytics),
            ("POST", "/api/v1/crawl", self.crawl),
            ("POST", "/api/v1/crawl/jobs", lambda q, b: (202, job_of(engine.enqueue(self.urls(b))))),
            ("GET", "/api/v1/crawl/jobs/([^/]+)", self.job),
            ("GET", "/api/v1/crawl/stale", lambda q, b: (200, {"candidates": self.candidates(number(q, "limit", 10))})),
            ("POST", "/api/v1/crawl/stale", self.recrawl),
            ("GET", "/api/v1/search", self.search),
            ("GET", "/api/v1/suggest", lambda q, b: (200, {"query": q.get("q", ""), "suggestions": engine.suggest(q.get("q", ""), number(q, "limit", 6))})),
        ]

    def urls(self, body: bytes) -> list[str]:
        try:
            given = json.loads(body)["urls"]
        except (ValueError, KeyError, TypeError):
            raise Refused(400, "invalid request body") from None
        found = [u.strip() for u in given if isinstance(u, str) and u.strip()] if isinstance(given, list) else []
        if not found:
            raise Refused(400, "at least one url is required")
        return found

    def analytics(self, q: dict, body: bytes) -> tuple[int, dict]:
        totals, top = self.engine.analytics()
        return 200, totals.first().asDict() | {"top_queries": top.collect(), "uptime_seconds": int(self.engine.clock() - self.engine.started)}

    def crawl(self, q: dict, body: bytes) -> tuple[int, dict]:
        urls = self.urls(body)
        try:
            return 201, crawled(self.engine.crawl(urls))
        except Exception as e:
            raise Refused(502, str(e)) from e

    def job(self, q: dict, body: bytes, job_id: str) -> tuple[int, dict]:
        if job_id not in self.engine.jobs:
            raise Refused(404, "crawl job not found")
        return 200, job_of(self.engine.jobs[job_id])

    def candidates(self, limit: int) -> list[dict]:
        return [{"document_id": r["id"], "url": r["url"], "title": r["title"], "recrawl_after": r["recrawl_after"], "stale_for_hours": r["staleness_hours"]} for r in self.engine.stale(limit).collect()]

    def recrawl(self, q: dict, body: bytes) -> tuple[int, dict]:
        job = self.engine.recrawl_due(number(q, "limit", 10))
        return (202, job_of(job)) if job else (200, {"status": "noop"})

    def search(self, q: dict, body: bytes) -> tuple[int, dict]:
        options = {"sort_by": q.get("sort", ""), "min_trust": number(q, "min_trust", 0), "domain": q.get("domain", ""), "offset": number(q, "offset", 0), "trusted_only": q.get("trusted_only", "").lower() in ("1", "true")}
        began = self.engine.clock()
        out = self.engine.search(q.get("q", ""), number(q, "limit", 10), **options)
        return 200, response(out, int(1000 * (self.engine.clock() - began)))

    def handle(self, method: str, path: str, query: str = "", body: bytes = b"") -> tuple[int, dict]:
        given = {k: v[0] for k, v in parse_qs(query, keep_blank_values=True).items()}
        known = [(m, f, hit.groups()) for m, pattern, f in self.routes if (hit := re.fullmatch(pattern, path))]
        try:
            if not known:
                raise Refused(404, "not found")
            for m, f, parts in known:
                if m == method:
                    return f(given, body, *parts)
            raise Refused(405, "method not allowed")
        except Refused as e:
            return e.status, {"error": str(e)}
        except Exception as e:
            return 500, {"error": str(e)}

    def page(self) -> bytes | None:
        """The page at the root, if there is one."""
        path = Path(self.web_root, "index.html") if self.web_root else None
        return path.read_bytes() if path and path.is_file() else None

    def __call__(self, environ: dict, start_response: Callable) -> Iterable[bytes]:
        if environ.get("PATH_INFO", "/") == "/" and environ["REQUEST_METHOD"] in ("GET", "HEAD") and (page := self.page()) is not None:
            start_response("200 OK", [("Content-Type", "text/html; charset=utf-8"), *HEADERS[1:]])
            return [page]
        size = min(int(environ.get("CONTENT_LENGTH") or 0), BODY_BYTES)
        status, said = self.handle(environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/"), environ.get("QUERY_STRING", ""), environ["wsgi.input"].read(size) if size else b"")
        start_response(f"{status} {REASONS[status]}", HEADERS)
        return [json.dumps(plain(said), ensure_ascii=False).encode()]


#: Seconds that a client may take for a request, or leave a connection idle.
CLIENT_SECONDS = 10


class Handler(WSGIRequestHandler):
    timeout = CLIENT_SECONDS

    def log_message(self, *args) -> None:
        pass


class Server(ThreadingMixIn, WSGIServer):
    daemon_threads = True


def server(engine: Engine, config: Config, web_root: str | None = None) -> Server:
    """A server at the address of the settings, whose jobs run in the background; ``serve_forever`` starts it."""
    engine.start_worker()
    host, port = config.host_port
    return make_server(host, port, Api(engine, web_root), Server, Handler)

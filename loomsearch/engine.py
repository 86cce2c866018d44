"""The engine: what the routes of a search service need, as methods."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ingest, log, suggest
from .operators.index import Index, IndexStore, index_stats
from .plans.lineage import cut
from .plans.query import Options
from .plans.search import Response, search
from .schema import QUERY_LOG
from .sources.caches import MemoryCache


@dataclass
class Crawl:
    """What one crawl did; its tables are as small as the request."""

    documents: DataFrame
    duplicates: DataFrame
    issues: DataFrame
    discovered: list[str]
    counts: dict


@dataclass
class Job:
    job_id: str
    urls: list[str]
    status: str = "queued"
    error: str = ""
    counts: dict = field(default_factory=dict)
    crawl: Crawl | None = None
    created_at: datetime | None = None
    started_at: datetime | None = None
    finished_at: datetime | None = None


#: Jobs that wait at most; a full queue works its oldest off before it takes another.
QUEUE_DEPTH = 32
#: Answers that are held at most, and rows of the query log that the driver holds.
CACHED_ANSWERS, LOG_ROWS = 200, 10_000


class Engine:
    """Searches one corpus.

    ``fetch`` turns urls into a DataFrame of documents, with a column ``error``
    where pages can fail; ``discover`` turns urls into (root, pos, url) rows.
    With ``index_path`` the index is kept in that folder: it is built once, a
    crawl adds its documents to it, and searches read the rows of their terms.
    Without ``docs`` the corpus is what that folder holds.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame | None = None, fetch=None, summarize=None, ttl_seconds: int = 120, clock=time.time, discover=None, index_path: str | None = None) -> None:
        self.spark, self.fetch, self.discover, self.summarize, self.clock = spark, fetch, discover, summarize, clock
        self.cache = MemoryCache(ttl_seconds, CACHED_ANSWERS, clock, lambda held: held[0].release())
        self.queries: list[tuple] = []
        self.logged: list[DataFrame] = []
        self.jobs: dict[str, Job] = {}
        self.deduplicated, self.started = 0, clock()
        self.lock, self.wake, self.worker = threading.RLock(), threading.Event(), None
        self.store = IndexStore(spark, index_path) if index_path else None
        if self.store and docs is not None:
            self.store.append(docs)
        self._use(docs)

    def _use(self, docs: DataFrame | None) -> None:
        self.index = self.store.index() if self.store else Index.of(docs)
        self.docs = self.index.docs
        self.cache.delete_prefix("search:")

    def _log(self, *row) -> None:
        """Adds to the query log; a full list becomes a table."""
        self.queries.append(row)
        if len(self.queries) >= LOG_ROWS:
            self.logged.append(cut(self.spark.createDataFrame(self.queries, QUERY_LOG)))
            self.queries = []

    def _now(self) -> datetime:
        return datetime.fromtimestamp(self.clock(), timezone.utc)

    def search(self, query: str, limit: int = 10, **options) -> Response:
        """A response; the same request within the time to live gets the same one, marked as cached."""
        began, key = self.clock(), f"search:{(query.strip().lower(), limit, sorted(options.items()))}"
        held = self.cache.get(key)
        if held:
            self._log(query, held[1], True, self._now())
            return replace(held[0], cached=True)
        out = search(self.index, query, limit, Options(**options), F.lit(self._now()), self.summarize)
        if query.strip():
            took = int(1000 * (self.clock() - began))
            self.cache.set(key, (out, took))
            self._log(out.normalized_query, took, False, self._now())
        return out

    def suggest(self, prefix: str, limit: int = 6) -> list[str]:
        return [r["value"] for r in suggest.completions(self.index.terms, self.index.phrases, prefix, limit).collect()]

    def analytics(self) -> tuple[DataFrame, DataFrame]:
        rows = self.spark.createDataFrame(self.queries, QUERY_LOG)
        for part in self.logged:
            rows = rows.unionByName(part)
        return log.analytics(rows), log.top_queries(rows)

    def stale(self, limit: int = 10) -> DataFrame:
        return ingest.stale(self.docs, F.lit(self._now()), limit)

    def stats(self) -> dict:
        row = index_stats(self.docs).first().asDict()
        return row | {"stale_documents": self.docs.where(F.col("recrawl_after") <= F.lit(self._now())).count(), "crawl_jobs": len(self.jobs), "deduplicated_urls": self.deduplicated}

    def expand(self, urls: list[str]) -> tuple[list[str], list[str]]:
        """All urls to fetch, and those of them that were discovered."""
        if self.discover is None or not urls:
            return urls, []
        roots = self.spark.createDataFrame([(u, k) for k, u in enumerate(dict.fromkeys(urls))], "root string, root_pos int")
        rows = ingest.expanded(roots, self.discover(urls)).orderBy("root", "url").collect()  # 25 for each root at most
        return [r["url"] for r in rows], [r["url"] for r in rows if r["discovered"]]

    def crawl(self, urls: list[str]) -> Crawl:
        """Fetches, drops copies, upserts, and forgets cached answers."""
        urls, discovered = self.expand([u.strip() for u in urls if u.strip()])
        fetched = self.fetch(urls)
        if "error" not in fetched.columns:
            fetched = fetched.withColumn("error", F.lit(None).cast("string"))
        fetched = cut(fetched.withColumn("seq", F.monotonically_increasing_id()))
        issues = fetched.where("error IS NOT NULL").select("url", "error")
        batch = fetched.where("error IS NULL").drop("error")
        copies = cut(ingest.duplicates(batch, self.docs))
        new = cut(ingest.accepted(batch, self.docs).drop("seq"))
        counts = {"documents": new.count(), "duplicates": copies.count(), "issues": issues.count()}
        self.deduplicated += counts["duplicates"]
        if self.store:
            self.store.append(new.select(*self.docs.columns))
        self._use(None if self.store else cut(ingest.upsert(self.docs, new)))
        return Crawl(new, copies, issues, discovered, counts)

    def enqueue(self, urls: list[str]) -> Job:
        urls = [u.strip() for u in urls if u.strip()]
        if not urls:
            raise ValueError("at least one url is needed")
        while sum(j.status == "queued" for j in self.jobs.values()) >= QUEUE_DEPTH:
            self.run_jobs(1)
        job = Job(f"crawl-{len(self.jobs) + 1}", urls, created_at=self._now())
        self.jobs[job.job_id] = job
        self.wake.set()
        return job

    def recrawl_due(self, limit: int = 10) -> Job | None:
        urls = [r["url"] for r in self.stale(limit).collect()]
        return self.enqueue(urls) if urls else None

    def run_jobs(self, most: int | None = None) -> None:
        """Works the queue off in order; a job that fails says why and does not stop the next."""
        with self.lock:  # one job at a time, whoever asks
            self._run_jobs(most)

    def start_worker(self) -> threading.Thread:
        """A background thread that runs jobs as they are queued; ``stop_worker`` ends it after the job at hand."""
        if self.worker is None or not self.worker.is_alive():
            self.stopping = False

            def work() -> None:
                while not self.stopping:
                    self.wake.wait(1)
                    self.wake.clear()
                    if not self.stopping:
                        self.run_jobs()

            self.worker = threading.Thread(target=work, name="crawl-jobs", daemon=True)
            self.worker.start()
        return self.worker

    def stop_worker(self) -> None:
        self.stopping = True
        self.wake.set()
        if self.worker is not None:
            self.worker.join()

    def _run_jobs(self, most: int | None) -> None:
        for job in [j for j in self.jobs.values() if j.status == "queued"][:most]:
            job.status, job.started_at = "running", self._now()
            try:
                job.crawl = self.crawl(job.urls)
                job.counts, job.status = job.crawl.counts, "completed"
            except Exception as e:
                job.status, job.error = "failed", str(e)
            job.finished_at = self._now()

import io
import json
from datetime import timedelta

import pytest

from loomsearch.api import Api
from loomsearch.engine import QUEUE_DEPTH, Engine

from .fixtures import NOW, doc, frame

LONG = "premium search guide for teams that want fast answers and facets " * 4


@pytest.fixture(scope="module")
def api(spark):
    docs = frame(spark, doc("1", "Premium search", LONG, recrawl=timedelta(hours=-3)), doc("2", "Search notes", LONG, url="https://other.org/2"))

    def fetch(urls):
        from pyspark.sql import functions as F

        good = frame(spark, *[doc(f"n{u}", "fresh page", u, url=u, fingerprint=u[-1]) for u in urls if "bad" not in u])
        bad = frame(spark, *[doc(u, "", url=u) for u in urls if "bad" in u])
        return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad.withColumn("error", F.lit("status 500")))

    discover = lambda urls: spark.createDataFrame([(u, 0, f"{u}found") for u in urls if u.endswith("/")], "root string, pos int, url string")
    return Api(Engine(spark, docs, fetch, clock=lambda: NOW.timestamp(), discover=discover))


def test_search(api):
    status, said = api.handle("GET", "/api/v1/search", "q=premium+search&limit=1&min_trust=x&trusted_only=no")
    assert status == 200 and said["count"] == 2 and said["has_more"] and said["results"][0]["document_id"] == "1"
    assert said["results"][0]["signals"]["title_match_boost"] > 0 and len(said["timeline"]) == 4 and said["quality"]["highlights"]
    assert api.handle("GET", "/api/v1/search", "q=")[1]["count"] == 0
    assert [r["document_id"] for r in api.handle("GET", "/api/v1/search", "q=search&trusted_only=TRUE&min_trust=0")[1]["results"]] in ([], ["2"])


def test_suggest_health_and_analytics(api):
    assert api.handle("GET", "/api/v1/suggest", "q=pre")[1]["suggestions"][0] == "premium"
    assert api.handle("GET", "/healthz")[1]["stats"]["documents"] >= 2 and api.handle("GET", "/readyz")[1]["status"] == "ready"
    status, said = api.handle("GET", "/api/v1/analytics")
    assert status == 200 and said["total_queries"] >= 1


def test_stale_and_jobs(api):
    status, said = api.handle("GET", "/api/v1/crawl/stale", "limit=5")
    assert [c["stale_for_hours"] for c in said["candidates"]] == [3]
    status, job = api.handle("POST", "/api/v1/crawl/stale")
    assert status == 202 and job["status"] == "queued" and api.handle("GET", f"/api/v1/crawl/jobs/{job['id']}")[0] == 200
    assert api.handle("GET", "/api/v1/crawl/jobs/none")[0] == 404


def test_crawl_with_issues_and_discovery(api):
    body = json.dumps({"urls": ["https://a.org/", " ", "https://bad.org/x"]}).encode()
    status, said = api.handle("POST", "/api/v1/crawl", body=body)
    assert status == 201, said
    assert said["discovered"] == ["https://a.org/found"] and [i["url"] for i in said["issues"]] == ["https://bad.org/x"]
    assert sorted(r["url"] for r in said["documents"]) == ["https://a.org/", "https://a.org/found"]


def test_refusals(api):
    assert api.handle("POST", "/api/v1/search")[0] == 405 and api.handle("GET", "/nothing")[0] == 404
    for body in (b"", b"{", b"[]", b'{"urls": []}', b'{"urls": 3}'):
        assert api.handle("POST", "/api/v1/crawl/jobs", body=body)[0] == 400


def test_wsgi(api):
    got = []
    body = b"".join(api({"REQUEST_METHOD": "GET", "PATH_INFO": "/readyz", "wsgi.input": io.BytesIO()}, lambda *a: got.append(a)))
    assert json.loads(body)["status"] == "ready" and got[0][0] == "200 OK" and ("X-Frame-Options", "DENY") in got[0][1]


def test_full_queue_works_off_its_oldest(spark):
    e = Engine(spark, frame(spark, doc("1", "search")), fetch=lambda urls: 1 / 0)
    for k in range(QUEUE_DEPTH + 2):
        e.enqueue([f"https://x.org/{k}"])
    assert sum(j.status == "queued" for j in e.jobs.values()) == QUEUE_DEPTH and e.jobs["crawl-1"].status == "failed"

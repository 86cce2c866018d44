import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from loomsearch.engine import Engine
from loomsearch.operators import authority, results
from loomsearch.operators.index import Index
from loomsearch.plans.query import Options
from loomsearch.plans.search import answered, search
from loomsearch.sources.summaries import remote

from .fixtures import NOW, doc, frame

LONG = "premium search guide for teams that want fast answers, facets, filters and ranking they can explain to others in detail and at length, " * 2


def run(spark, docs, query, limit=10, **options):
    return search(Index.of(frame(spark, *docs)), query, limit, Options(**options), F.lit(NOW))


def ids(out):
    return [r["id"] for r in out.page.orderBy("pos").collect()]


def test_title_and_phrase_come_first(spark):
    out = run(spark, [doc("doc-1", "Go Search Engine", LONG + "go search engine"), doc("doc-2", "Distributed Systems Notes", "search in go systems")], "go search engine")
    assert ids(out)[0] == "doc-1"
    top = out.page.orderBy("pos").first()
    assert top["title_boost"] > 0 and top["phrase_boost"] > 0
    labels = [e["label"] for e in top["explanations"]]
    assert labels[0] == "Base rank" and "Title match" in labels and "Phrase match" in labels


def test_related_trust_and_quality(spark):
    one = doc("doc-1", "Go Search Engine", "Go search engine ranking signals and snippets.", description="Go search engine tutorial")
    two = doc("doc-2", "Go Search Dashboard", "Go search dashboard for ranking analytics and premium search views.", description="Premium search dashboard")
    out = run(spark, [one, two], "go se")
    assert out.tables["related"].first()["phrase"] == "go search engine"
    assert out.tables["quality"].first()["average_trust"] > 0


def test_min_trust_and_thin_page(spark):
    high = doc("doc-high", "Premium search", "premium search " + "x" * 30, description="a page", url="https://example.com/a")
    thin = doc("doc-low", "Search", "search", url="http://localhost/x")
    out = run(spark, [high, thin], "premium search", min_trust=80)
    assert ids(out) == ["doc-high"] and out.page.first()["trust"]["value"] == 80
    low = run(spark, [thin], "search")
    t = low.page.first()["trust"]
    assert (t["value"], t["level"]) == (54, "review") and low.tables["quality"].first()["needs_review"] == 1


def test_recent_freshness_and_undated(spark):
    docs = [doc("old", "search archive", LONG, age=timedelta(hours=2)), doc("new", "search archive", LONG), doc("none", "search archive", LONG, age=None)]
    assert ids(run(spark, docs, "search archive", sort_by="recent")) == ["new", "old", "none"]
    docs = [doc("a-old", "premium search update", age=timedelta(days=10)), doc("b-new", "premium search update")]
    assert ids(run(spark, docs, "premium search update"))[0] == "b-new"


def test_authority_prefers_the_linked_page(spark):
    target = doc("b-target", "search", LONG)
    out = run(spark, [doc("a-source", "search", LONG, links=[target["url"]]), target], "search")
    boosts = {r["id"]: r["authority_boost"] for r in out.page.collect()}
    assert boosts["b-target"] == pytest.approx(0.5) and boosts["a-source"] < 0.5
    alone = authority.authority(frame(spark, doc("x", "a"), doc("y", "b")).select("id", "url", "links")).collect()
    assert [r["authority"] for r in alone] == [1.0, 1.0]


def test_domain_paging_and_diversity(spark):
    docs = [doc(f"d{i}", "premium search", LONG, url=f"https://site-{i}.example.com/") for i in range(3)]
    out = run(spark, docs, "premium search", 2, offset=1)
    assert out.count == 3 and len(ids(out)) == 2 and not out.has_more
    one = run(spark, docs, "premium search", domain="site-1.example.com")
    assert ids(one) == ["d1"] and one.tables["domains"].count() == 1
    same = [doc(f"a{i}", "search", LONG, url=f"https://alpha.example.com/{i}") for i in range(3)] + [doc("b", "search", LONG, url="https://beta.example.com/")]
    got = run(spark, same, "search").rows.groupBy("domain").count().collect()
    assert {r["domain"]: r["count"] for r in got} == {"alpha.example.com": 2, "beta.example.com": 1}


def test_typo(spark):
    out = run(spark, [doc("1", "Premium Search", LONG)], "premum searh")
    assert (out.corrected_query, out.count) == ("premium search", 1)


def test_operators_narrow_results(spark):
    docs = [doc("1", "Premium search guide", LONG, url="https://docs.example.com/search"), doc("2", "Premium search guide", LONG + " ads", url="https://blog.example.com/")]
    out = run(spark, docs, 'site:example.com "premium search guide" -ads')
    assert ids(out) == ["1"] and out.interpretation["intent"] == "navigational" and out.interpretation["excluded_terms"] == ["ads"]
    heads = doc("1", "Premium Search", LONG, url="https://example.com/search", headings=["Search guide", "Other"])
    out = run(spark, [heads, doc("2", "Notes", LONG)], "intitle:premium inurl:search guide")
    row = out.page.first()
    assert ids(out) == ["1"] and row["site_links"] == ["Search guide", "Other"] and row["match_context"]


def test_file_type_and_dates(spark):
    docs = [doc("pdf", "premium search", LONG, url="https://example.com/report.pdf", age=timedelta(days=2)), doc("html", "premium search", LONG, url="https://example.com/archive.html", age=timedelta(days=10))]
    out = run(spark, docs, "premium search filetype:pdf after:2026-04-15 before:2026-04-19")
    assert ids(out) == ["pdf"] and out.page.first()["file_type"] == "pdf" and out.interpretation["after"] == "2026-04-15"


def test_trusted_hosts_only(spark):
    text = "health search " + LONG
    docs = [doc("cdc", "health search", text, url="https://www.cdc.gov/x", description="health search"), doc("com", "health search", text, url="https://example.com/", description="health search")]
    assert ids(run(spark, docs, "health search", trusted_only=True)) == ["cdc"]


def test_coverage_timeline_and_compare(spark):
    docs = [doc("a1", "search one", LONG, url="https://alpha.org/1"), doc("a2", "search two", LONG, url="https://alpha.org/2", age=timedelta(hours=48)), doc("b", "search three", LONG, url="https://beta.org/", age=timedelta(days=40))]
    out = run(spark, docs, "search")
    assert out.tables["coverage"].first()["domain"] == "alpha.org"
    assert [(r["bucket"], r["count"]) for r in out.tables["timeline"].collect()] == [("Past day", 1), ("Past week", 1), ("Past month", 0), ("Older", 1)]
    assert out.tables["compare"].count() == 3
    assert sum(r["count"] for r in out.tables["domains"].collect()) == out.count
    assert out.answer["generated"] and len(out.answer["citations"]) == 3


def test_blank_and_operator_only_queries_find_nothing(spark):
    idx = Index.of(frame(spark, doc("1", "search")))
    assert search(idx, "  ").count == 0
    assert search(idx, "site:example.com", as_of=F.lit(NOW)).count == 0


def test_engine_caches_crawls_and_recrawls(spark):
    clock = [NOW.timestamp()]
    new = frame(spark, doc("n", "search fresh", LONG, fingerprint="f1"), doc("m", "search fresh", LONG, fingerprint="f1"))
    fetched = []

    def fetch(urls):
        fetched.append(urls)
        return new

    docs = frame(spark, doc("1", "search", LONG, recrawl=timedelta(hours=-2)), doc("2", "search", LONG, recrawl=timedelta(hours=48)))
    e = Engine(spark, docs, fetch, clock=lambda: clock[0])
    first = e.search("search")
    assert not first.cached and e.search("search").cached
    totals, top = e.analytics()
    row = totals.first()
    assert (row["total_queries"], row["cache_hits"]) == (2, 1) and top.first()["query"] == "search"
    clock[0] += 121
    assert not e.search("search").cached
    job = e.recrawl_due()
    assert job.urls == ["https://example.com/1"] and e.stats()["stale_documents"] == 1
    e.run_jobs()
    assert job.status == "completed" and job.counts == {"documents": 1, "duplicates": 1, "issues": 0} and fetched == [job.urls]
    assert e.search("fresh").count == 1
    assert e.suggest("sea")[0] == "search"
    with pytest.raises(ValueError):
        e.enqueue(["  "])
    bad = Engine(spark, docs, lambda urls: 1 / 0)
    job = bad.enqueue(["https://x.org/"])
    bad.run_jobs()
    assert job.status == "failed" and "division" in job.error


def test_summaries_and_their_fallback():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            broken = seen[-1]["query"] == "bad"
            self.send_response(500 if broken else 200)
            self.end_headers()
            self.wfile.write(b"" if broken else json.dumps({"query": "q", "summary": "said", "grounded_points": ["a"]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = remote(f"http://127.0.0.1:{server.server_port}/")
    assert answered("q", ["a", "b", "c", "d"], 9, ask) == {"query": "q", "summary": "said", "grounded_points": ["a"], "generated": True} and seen[0]["snippets"] == ["a", "b", "c", "d"]
    fallen = answered("bad", ["a", " ", "b"], 9, ask)
    server.shutdown()
    assert fallen["grounded_points"] == ["a", "b"] and not fallen["generated"]
    assert answered("q", [], 0)["summary"].startswith("No grounded") and answered("q", ["a"], 1)["generated"]


def test_paging_partitions_the_list(spark):
    out = run(spark, [doc(f"d{i:02}", "search " + "word " * i, LONG, url=f"https://s{i}.org/") for i in range(7)], "search", 7)
    pages = [[r["id"] for r in results.page(out.rows, Options(offset=k), 3).orderBy("pos").collect()] for k in range(0, 9, 3)]
    assert [x for p in pages for x in p] == ids(out) and [len(p) for p in pages] == [3, 3, 1]

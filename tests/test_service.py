"""Stored indexes, stores, caches, settings, and fetching from a server of the test's own."""

import socket
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from loomsearch.api import CLIENT_SECONDS, server
from loomsearch.config import Config
from loomsearch.engine import Engine
from loomsearch.operators.index import Index, IndexStore, bm25
from loomsearch.sources import stores
from loomsearch.sources.caches import MemoryCache, RedisCache
from loomsearch.sources.fetch import discoverer, fetcher, get, responses

from .fixtures import NOW, doc, frame


def same(a: Index, b: Index) -> None:
    """Equal tables, and equal scores of a search."""
    rows = lambda df, *names: sorted(tuple(r[n] for n in names) for r in df.collect())
    assert rows(a.docs, "id", "title") == rows(b.docs, "id", "title")
    assert rows(a.postings, "term", "id", "tf") == rows(b.postings, "term", "id", "tf")
    assert rows(a.terms, "term", "df") == rows(b.terms, "term", "df") and rows(a.phrases, "phrase", "freq") == rows(b.phrases, "phrase", "freq")
    assert rows(a.doc_stats, "id", "dl") == rows(b.doc_stats, "id", "dl") and tuple(a.corpus.first()) == pytest.approx(tuple(b.corpus.first()))
    score = lambda i: {r["id"]: r["score"] for r in bm25(i, ["search", "fast"]).collect()}
    assert score(a) == pytest.approx(score(b))


def test_an_index_that_is_added_to_is_one_built_at_once(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), most=2)
    assert store.segments() == [] and store.docs() is None
    one, two = [doc("1", "search engines", "fast search"), doc("2", "old notes", "plain words")], [doc("2", "new notes", "fast words"), doc("3", "search", "of the third")]
    store.append(frame(spark, *one))
    same(store.index(), Index.of(frame(spark, *one)))
    store.append(frame(spark, *two))
    same(store.index(), Index.of(frame(spark, one[0], *two)))
    store.append(frame(spark, doc("1", "gone over", "twice fast"), doc("2", "third notes")))  # a third segment: they are merged
    assert store.segments() == [4]
    same(store.index(), Index.of(frame(spark, doc("1", "gone over", "twice fast"), doc("2", "third notes"), two[1])))
    store.append(frame(spark).limit(0))
    same(store.index(), Index.of(frame(spark, doc("1", "gone over", "twice fast"), doc("2", "third notes"), two[1])))
    plan = store.index().postings.where(F.col("term").isin("fast"))._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term,fast)" in plan  # the term filter reaches the scans


def test_an_engine_reads_a_written_index(spark, tmp_path):
    path, long = str(tmp_path / "index"), "search notes for teams that want fast answers " * 5
    new = frame(spark, doc("n", "fresh search", long, fingerprint="f1"), doc("1", "search again", long, fingerprint="f2"))
    engine = Engine(spark, frame(spark, doc("1", "search", long), doc("2", "other search", long)), lambda urls: new, clock=lambda: NOW.timestamp(), index_path=path)
    first = engine.search("saerch")  # corrected
    assert first.normalized_query == "search" and first.count == 2
    again = engine.search("saerch")
    assert again.cached and not first.cached
    engine.crawl(["https://example.com/n"])
    assert engine.search("fresh").count == 1 and engine.search("again").count == 1 and engine.stats()["documents"] == 3
    later = Engine(spark, clock=lambda: NOW.timestamp(), index_path=path)
    assert later.search("search").count == engine.search("search").count == 2  # at most two of a domain
    assert later.suggest("fre") == engine.suggest("fre") == ["fresh", "fresh search"]


def test_worker_runs_queued_jobs(spark):
    engine = Engine(spark, frame(spark, doc("1", "search")), lambda urls: frame(spark, doc("2", "found", fingerprint="f")), clock=lambda: NOW.timestamp())
    engine.start_worker()
    job = engine.enqueue(["https://example.com/2"])
    for _ in range(600):
        if job.status in ("completed", "failed"):
            break
        threading.Event().wait(0.1)
    engine.stop_worker()
    assert job.status == "completed" and job.counts["documents"] == 1 and not engine.worker.is_alive()


def test_query_log_is_bounded(spark, monkeypatch):
    monkeypatch.setattr("loomsearch.engine.LOG_ROWS", 3)
    engine = Engine(spark, frame(spark, doc("1", "search")), clock=lambda: NOW.timestamp())
    for k in range(7):
        engine._log(f"q{k % 2}", 1, False, engine._now())
    totals, top = engine.analytics()
    assert len(engine.queries) == 1 and totals.first()["total_queries"] == 7 and [tuple(r) for r in top.collect()] == [("q0", 4), ("q1", 3)]


def test_memory_cache():
    now, dropped = [0.0], []
    cache = MemoryCache(10, 2, lambda: now[0], dropped.append)
    cache.set("search:a", 1), cache.set("search:b", 2)
    assert cache.get("search:a") == 1
    cache.set("other:c", 3)
    assert cache.get("search:b") is None and dropped == [2]
    assert cache.delete_prefix("search:") == 1 and cache.get("other:c") == 3
    now[0] = 11
    assert cache.get("other:c") is None and dropped == [2, 1, 3] and cache.get("none") is None


def test_redis_cache():
    class Client(dict):
        def set(self, key, value, ex):
            self[key] = value

        def scan_iter(self, match, count):
            prefix = match[:-1].replace("\\", "")
            return [k for k in self if k.startswith(prefix)]

        def delete(self, *keys):
            return sum(self.pop(k, None) is not None for k in keys)

    cache = RedisCache(client=Client())
    cache.set("search:a*", "x"), cache.set("search:b", "y"), cache.set("other", "z")
    assert cache.get("search:a*") == "x" and cache.delete_prefix("search:a*") == 1 and cache.delete_prefix("search:") == 1 and cache.get("other") == "z"
    with pytest.raises((RuntimeError, OSError)):
        RedisCache("127.0.0.1:1")


def test_config():
    assert Config.load({}) == Config() and Config.load({}).host_port == ("0.0.0.0", 8080)
    c = Config.load({"LOOM_ADDRESS": "127.0.0.1:9", "LOOM_STORE": "jdbc", "LOOM_USER_AGENT": ""})
    assert c.host_port == ("127.0.0.1", 9) and c.store == "jdbc" and c.user_agent == Config().user_agent


def test_jdbc_store(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    docs = frame(spark, doc("1", "one", links=["https://a.org/"], fingerprint="f"), doc("2", "two"))
    docs.withColumns({c: F.to_json(c) for c in stores.LISTS}).limit(0).write.option("createTableColumnTypes", "id VARCHAR(255), content_fingerprint VARCHAR(255)").jdbc(url, "documents", "overwrite", {"driver": driver})
    store = stores.JdbcStore(spark, url, driver=driver)
    store.save(docs)
    store.save(frame(spark, doc("2", "two again", fingerprint="g"), doc("3", "three", headings=["h"])))
    assert sorted((r["id"], r["title"]) for r in store.scan().collect()) == [("1", "one"), ("2", "two again"), ("3", "three")]
    assert store.get("1").first()["links"] == ["https://a.org/"] and store.get("3").first()["headings"] == ["h"] and store.get("9").count() == 0
    assert store.by_fingerprint("g").first()["id"] == "2" and store.latest(2).count() == 2
    stores.execute(spark, url, "UPDATE documents SET \"links\" = '{broken' WHERE \"id\" = '1'", properties={"driver": driver})
    assert sorted(r["id"] for r in store.scan().collect()) == ["2", "3"]
    with pytest.raises(Exception):
        stores.execute(spark, url, "DELETE FROM documents", "no statement", properties={"driver": driver})
    assert store.scan().count() == 2
    assert stores.upsert_statement("jdbc:postgresql://h/d", "documents", "s", ["id", "url"]) == 'INSERT INTO documents ("id", "url") SELECT "id", "url" FROM s WHERE TRUE ON CONFLICT ("id") DO UPDATE SET "url" = EXCLUDED."url"'


def test_store_fallback(spark, tmp_path):
    c = Config(store="jdbc", database_url="jdbc:nothing:here", store_path=str(tmp_path / "docs"))
    store = stores.open_store(spark, c)
    assert isinstance(store, stores.ParquetStore) and store.get("1") is None


@pytest.fixture(scope="module")
def site():
    seen = []
    pages = {
        "/robots.txt": "Disallow: /early\nUser-agent: *\nDisallow: /private\n", "/": "<title>Home</title><p>home page</p>", "/a": "<title>A</title><p>page a</p>", "/private/x": "no", "/early/x": "no",
        "/sitemap.xml": "<urlset><url><loc>/a</loc></url><url><loc>/private/x</loc></url></urlset>", "/long": "x" * (3 << 20),
    }

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["User-Agent"]))
            self.send_response(200 if self.path in pages else 503 if self.path == "/broken" else 404)
            self.end_headers()
            self.wfile.write(pages.get(self.path, "").encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen, pages
    server.shutdown()


def test_fetching_with_robots_and_sitemaps(spark, site):
    root, seen, _ = site
    engine = Engine(spark, frame(spark).limit(0), fetcher(spark, "LoomBot/1", lambda: F.lit(NOW)), discover=discoverer(spark, "LoomBot/1"), clock=lambda: NOW.timestamp())
    done = engine.crawl([f"{root}/", f"{root}/broken", f"{root}/early/x", "ftp://x/", "http://127.0.0.1:1/x"])
    assert sorted(r["title"] for r in done.documents.collect()) == ["A", "Home"] and f"{root}/a" in done.discovered
    issues = {r["url"].replace(root, ""): r["error"] for r in done.issues.collect()}
    assert issues["/private/x"] == issues["/early/x"] == "blocked by robots.txt" and "503" in issues["/broken"] and "robots" in issues["http://127.0.0.1:1/x"] and "ftp" in issues["ftp://x/"]
    asked = [p for p, _ in seen]
    assert asked.count("/robots.txt") == 1 and asked.count("/a") == 1 and "/private/x" not in asked and all(agent == "LoomBot/1" for _, agent in seen)
    assert engine.search("page").count == 2


def test_robots_that_cannot_be_had_forbid(spark, site):
    root, _, pages = site
    rules, pages["/robots.txt"] = pages["/robots.txt"], "Disallow:\n"
    got = responses(spark.createDataFrame([(f"{root}/long",)], "url string"), "x").first()
    assert len(got["body"]) == 2 << 20 and got["status"] == 200
    pages["/robots.txt"] = rules
    from loomsearch.sources.crawling import rules as parsed
    from loomsearch.sources.crawling import unreadable

    robots = spark.createDataFrame([("a", "", 404), ("b", "", 403), ("c", "Disallow: /x", 200), ("d", None, None)], "host string, body string, status int")
    assert sorted(r["host"] for r in unreadable(robots).collect()) == ["b", "d"]
    assert [tuple(r) for r in parsed(robots).collect()] == [("c", "*", "/x")]


def test_server(tmp_path):
    """The root page, an unknown page, and a client that says nothing."""

    class Idle:
        started, clock = 0.0, staticmethod(lambda: 1.0)

        def start_worker(self):
            self.working = True

    idle = Idle()
    http = server(idle, Config(address="127.0.0.1:0"), str(tmp_path))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{http.server_port}"
    assert get(f"{root}/", "t")[0] == 404 and idle.working
    (tmp_path / "index.html").write_text("<h1>hello</h1>")
    assert get(f"{root}/", "t") == (200, "<h1>hello</h1>", "") and get(f"{root}/other", "t")[0] == 404
    http.RequestHandlerClass.timeout = 0.2
    with socket.create_connection(("127.0.0.1", http.server_port)) as s:
        s.settimeout(5)
        assert s.recv(1) == b""  # closed from the other side
    http.RequestHandlerClass.timeout = CLIENT_SECONDS
    http.shutdown()

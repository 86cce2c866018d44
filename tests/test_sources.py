from datetime import timedelta

from pyspark.sql import functions as F

from loomsearch.functions import text
from loomsearch.sources import crawling, pages, stores

from .fixtures import NOW, doc, frame

PAGE = """<html><head><title>Premium &amp; Search</title><meta name="Description" content=" About  search "><link rel="canonical" href="/canon#top">
<style>.x{}</style><script>var s = "</p>";</script></head><body><header>Top</header><nav>Menu <a href="/nav">n</a></nav><main><h1>First <b>head</b></h1><p>Body text<p>second <strong>part</strong>
<a href="/docs#frag">Docs</a> <a href="https://other.org/x">x</a> <a href="mailto:a@b.c">m</a></main><form>hidden</form><footer>Foot</footer></body></html>"""


def test_extraction(spark):
    df = spark.createDataFrame([("https://Example.com:80/dir/page", PAGE), ("https://e.org/", ""), ("https://e.org/n", None)], "url string, html string")
    row, *empty = pages.extract(df).collect()
    assert (row["title"], row["description"], row["canonical"]) == ("Premium & Search", "About search", "https://Example.com:80/canon")
    assert row["headings"] == ["First head"]
    assert row["links"] == ["https://Example.com:80/nav", "https://Example.com:80/docs#frag", "https://other.org/x"]
    assert "Body text second part" in " ".join(row["content"].split()) and "Top" in row["content"] and "Premium & Search" in row["content"]
    assert not any(x in row["content"] for x in ("Menu", "Foot", "hidden", "var s"))
    assert all(e["title"] == "" and e["links"] == [] for e in empty)


def test_long_pages_are_read_to_their_end():
    html = "<p>" + "word " * 500_000 + "</p><h2>Last head</h2><p>closing words <a href='/end'>end</a></p>"
    title, *_, content, headings, links = pages.parts_of(html, "https://e.org/")
    assert headings == ["Last head"] and links == ["https://e.org/end"] and content.endswith("end") and "closing words" in content


def test_later_parts_replace_empty_ones():
    said = lambda html: pages.parts_of(html, "https://e.org/")
    assert said("<h1>A</h1><h4>Fourth</h4><h2>B</h2>")[4] == ["A", "B"]
    title, description, canonical, *_ = said('<title> </title><title>Second</title><meta name=description content=""><meta property=og:description content="og"><link rel="canonical nofollow" href=/x><link rel=Canonical href=/y>')
    assert (title, description, canonical) == ("Second", "og", "https://e.org/y")


def test_markup_that_no_parser_takes(monkeypatch):
    def broken(self, data):
        raise AssertionError

    monkeypatch.setattr(pages.Parts, "feed", broken)
    assert pages.parts_of("<p>a <b>b</b>\n c</p>", "https://e.org/") == ("", "", "", "a b c", [], [])


def test_page_documents(spark):
    df = spark.createDataFrame([("https://Example.com/dir/page", PAGE), ("https://e.org/x", "<p>no title</p>")], "url string, html string")
    a, b = pages.documents(df, F.lit(NOW)).orderBy(F.desc("title")).collect()
    first, second = (a, b) if a["domain"] == "example.com" else (b, a)
    assert first["url"] == "https://Example.com/canon" and first["domain"] == "example.com" and len(first["id"]) == 40
    assert second["title"] == "https://e.org/x" and second["recrawl_after"] - second["crawled_at"] == timedelta(days=7)


def test_strip_tags(spark):
    df = spark.createDataFrame([("<p>a <b>b</b>\n c</p>",)], "h string")
    assert df.select(pages.strip_tags(F.col("h"))).first()[0] == "a b c"


def test_urls(spark):
    rows = [("https://EXAMPLE.com:8080/a/b.PDF?x=1",), ("https://e.org/v1.2/page",), ("https://e.org/x.",), ("not a url",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "u string").select(text.host(F.col("u")), text.file_type(F.col("u"))).collect()]
    assert got[:3] == [("example.com", "pdf"), ("e.org", "html"), ("e.org", "html")] and got[3][0] == ""


def test_robots(spark):
    body = "# c\nUser-agent: *\nDisallow: /all\nUser-agent: LoomBot\nDisallow: /bots\nDisallow:\nAllow: /x"
    robots = spark.createDataFrame([("h", body, 200), ("gone", "x", 404)], "host string, body string, status int")
    rules = crawling.rules(robots)
    of = lambda agent: sorted(tuple(r) for r in crawling.rules_for(rules, agent).collect())
    assert crawling.robots_rules("Disallow: /early\nUser-agent: x\nDisallow: /late") == [("*", "/early"), ("x", ""), ("x", "/late")]
    assert of("loombot") == [("h", "/bots")] == of("LoomBot/1.0") and of("other") == [("h", "/all")]


def test_sitemaps(spark):
    xml = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>/a</loc></url><url><loc> https://x.org/b </loc></url></urlset>"
    maps = spark.createDataFrame([("https://x.org/", xml), ("https://x.org/deep", xml), ("https://y.org", "<broken"), ("https://z.org", "<sitemapindex><sitemap><loc>/s.xml</loc></sitemap></sitemapindex>")], "root string, xml string")
    got = sorted((r["root"], r["url"]) for r in crawling.sitemap_entries(maps).collect())
    assert got == [("https://x.org/", "https://x.org/a"), ("https://x.org/", "https://x.org/b"), ("https://z.org", "https://z.org/s.xml")]


def test_snippets(spark):
    body = "x" * 120 + " premium search " + "y" * 300
    df = spark.createDataFrame([(body,), ("short",), ("z" * 300,), ("  ",)], "c string")
    a, b, c, d = [r[0] for r in df.select(text.snippet(F.col("c"), "Premium Search", ["premium", "search"])).collect()]
    assert "premium search" in a and a.startswith("...") and a.endswith("...")
    assert (b, c, d) == ("short", "z" * 200 + "...", "")


def test_recrawl_order(spark):
    df = spark.createDataFrame([("https://e.org/news",), ("https://e.org/blog",), ("https://e.org/x",), ("https://e.org/guide",)], "u string")
    assert [r[0] for r in df.select(text.recrawl_days(F.col("u"))).collect()] == [1, 3, 7, 21]


def test_parquet_store(spark, tmp_path):
    store = stores.ParquetStore(spark, str(tmp_path / "store"))
    assert store.scan() is None
    store.save(frame(spark, doc("1", "old"), doc("2", "other")))
    store.save(frame(spark, doc("1", "new")))
    assert sorted((r["id"], r["title"]) for r in store.scan().collect()) == [("1", "new"), ("2", "other")]
    assert store.get("1").first()["title"] == "new" and store.get("9").count() == 0



from html.parser import HTMLParser

import pytest

from loomsearch.llm import html

from .helpers import SMALL, needs_tables

ARTICLE = "<p>This is the first long paragraph of an article that has quite a few words in it, so that it is plainly main text.</p><p>And a second   paragraph,\n with &amp; &eacute; &#x41; references and <b>bold</b><i>italic</i> words in the middle of it all.</p>"
TEXT = "This is the first long paragraph of an article that has quite a few words in it, so that it is plainly main text. And a second paragraph, with & é A references and bolditalic words in the middle of it all."


@pytest.fixture(scope="module")
def tree():
    return html.train()


def test_tree_fits_its_table(tree):
    x, y = html.labelled()
    assert sum(html.classify(tree, row) != label for row, label in zip(x, y, strict=True)) <= 0.02 * len(y)


@pytest.mark.parametrize("around", [
    "<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>{}", "{}<footer>Copyright 2024 by someone, all rights reserved</footer>", "<script>var x = '<p>no</p>';</script>{}<style>p {{}}</style>",
    "{}<aside><p>More stories that you may like to read next time</p></aside>", "<form><label>Your name here please</label><input></form>{}", "<div class='cookie-notice'>We use cookies to make this site better for you</div>{}",
    "{}<div id=comments><p>I think that this is a very good article and well written too</p></div>", "<!-- a <p>comment</p> -->{}", "<header><h1>Site name</h1><p>The tagline of a site</p></header>{}", "{}<div class='ad'>Buy our product now for less money than before</div>",
    "<head><title>t</title></head><body>{}",
])
def test_what_is_around_the_article_goes(tree, around):
    for body in (f"<article>{ARTICLE}</article>", f"<div>{ARTICLE}</div>"):
        assert html.extract(around.format(body), tree) == TEXT


def said(n, letter="w"):
    return " ".join(f"{letter}{k}" for k in range(n))


A, B, C, D, Z = ("<p>" + said(n, x) + "</p>" for n, x in ((30, "a"), (30, "b"), (20, "c"), (20, "d"), (30, "z")))
AB, TAIL = said(30, "a") + " " + said(30, "b"), " " + said(20, "c")
LINKS = "<ul><li><a href=x>one two</a><li><a href=y>three four</a></ul>"


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class='layout with-sidebar'><article>{A}{B}</article></div>", AB), (f"<div class='has-header'><main>{A}{B}</main></div>", AB), (f"<div class=header><main>{A}{B}</main></div>", AB),
    (f"<div id=sidebar><article>{A}{B}</article></div>", AB), (f"<div class=sidebar>{A}{B}</div>", AB), (f"<div class=sidebar-left><div role=main>{A}{B}</div></div>", AB),
    (f"<body class='comments-open sidebar'><div id=page class='no-sidebar header-fixed'>{A}{B}</div>", AB), (f"<form id=f action=x><div>{A}{B}</div></form>", AB), (f"<nav><ul><li><a href=x>h</a></ul><article>{A}{B}</article>", AB),
    (f"<article>{A}{B}{C}</article>{LINKS}", AB + TAIL), (f"<div>{A}{B}{C}</div>{LINKS}", AB + TAIL), (f"<article>{A}{B}{C}<h2><a href=x>one two</a></h2>{D}</article>", AB + TAIL + " one two " + said(20, "d")),
    (f"<div>{A}{B}{C}<h2><a href=x>one two</a></h2>{D}</div>", AB + TAIL + " one two " + said(20, "d")), (f"<article>{A}{B}<p class=legal-note>{said(60)}</p></article>", AB + " " + said(60)),
    (f"<article>{A}<ul><li>{said(3, 'c')}<li>{said(2, 'd')}</ul>{B}</article>", f"{said(30, 'a')} {said(3, 'c')} {said(2, 'd')} {said(30, 'b')}"), (f"<article>{A}<p><a href=x>{said(9, 'c')}</a></p>{B}</article>", f"{said(30, 'a')} {said(9, 'c')} {said(30, 'b')}"),
    (f"<div class=entry-header><h1>{said(6)}</h1></div><div class=entry-content>{A}{B}</div>", f"{said(6)} {AB}"), (f"<article><header><h1>{said(6)}</h1></header>{A}{B}</article>", f"{said(6)} {AB}"),
    (f"<head><title>t</title><meta charset=utf-8><body><div>{A}{B}</div>", AB), (f"<html><head><title>t</title><div>{A}{B}</div>", AB), ("<html><body><p>Short text only.</p></body></html>", "Short text only."),
])
def test_no_part_of_the_article_is_lost(tree, page, text):
    assert html.extract(page, tree) == text


@pytest.mark.parametrize("other", [
    f"<section id=comments><article>{Z}</article></section>", f"<ol class=comment-list><li><article class=comment-body>{Z}</article></li></ol>", f"<div id=comments>{Z * 9}</div>", f"<div class=post-comments>{Z}{Z}</div>",
    f"<div class=related-posts><article><h3><a href=x>{said(7, 'z')}</a></h3>{Z}</article></div>", f"<aside><article>{Z}</article></aside>", f"<div class=ad-slot>{Z}</div>", f"<p class=advert>{said(12, 'z')}</p>",
    f"<div class=newsletter-signup>{Z}</div>", f"<div class=cookie-banner>{Z}</div>", f"<div class='col sidebar'>{Z}</div>",
])
@pytest.mark.parametrize("around", ["<article>{}{}{}</article>", "<article>{}{}</article>{}", "<div>{}{}</div>{}", "<main><div class=row><div class=col>{}{}</div>{}</div></main>"])
def test_other_parts_go(tree, around, other):
    assert html.extract(around.format(A, B, other), tree) == AB


class Article(HTMLParser):
    """The text of a page's article elements, block by block: pages of the tables have one, and nothing else in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in ("a", "b", "i", "em", "strong", "span"):
            self.parts.append("")

    def handle_endtag(self, tag):
        self.handle_starttag("/" + tag if tag not in ("a", "b", "i", "em", "strong", "span") else tag, [])
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts[-1] += data


@needs_tables
def test_pages_against_brute_force(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in html.op5_html_extraction(spark, SMALL).collect():
        parser = Article()
        parser.feed(pages[r["page_id"]])
        parser.close()
        assert r["text"] == " ".join(" ".join(parser.parts).split())


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</p></div>", "<script>", "<!--", "<html></html>", "&", "<a href='x", "<![CDATA[", "\x00"])
def test_odd_pages_do_not_crash(tree, page):
    assert isinstance(html.extract(page, tree), str)


def test_long_and_deep_pages(tree):
    words = " ".join(f"word{i}" for i in range(50000))
    assert html.extract(f"<article><p>{words}</p></article>", tree) == words
    deep = "<div>" * 5000 + f"<article>{ARTICLE}</article>"
    assert html.extract(deep, tree) == TEXT
    assert len(html.blocks("<p>x" * 20000)) == 20000
    assert html.blocks("<" * 20000 + "p>x") is not None


def test_unclosed_paragraphs_are_blocks():
    assert [b.text for b in html.blocks("<p>one<p>two<br>three<li>four")] == ["one", "two", "three", "four"]


def test_link_density():
    b = html.blocks("<p>plain words <a href=x>linked words</a></p>")[0]
    assert (b.words, b.linked, b.density) == (4, 2, 0.5)


def test_operator(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", "x", 1), (1, "u", f"<article>{ARTICLE}</article>", "x", 2), (None, None, None, "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = html.extracted(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT))]
    assert html.extracted(pages.limit(0)).count() == 0


@needs_tables
def test_query(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = html.op5_html_extraction(spark, SMALL).collect()
    assert len(got) == pages.count() and sum(r["n_chars"] > 0 for r in got) >= 0.95 * len(got)
    assert all(r["n_chars"] == len(r["text"]) and "<p" not in r["text"] and "  " not in r["text"] for r in got)

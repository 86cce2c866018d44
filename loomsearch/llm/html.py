"""Main text of web pages: flat text blocks and a decision tree.

A page is read once into flat blocks of text, cut at block-level tags.  Each
block has its number of words and its link density, those of the blocks before
and after it, and what the tags around it say: whether it stands inside an
article, and whether the elements between it and that article are of a kind,
or are named, like something that is no main text.  A decision tree, trained
on the small table of labelled pages below, tells main text from the rest.

The nearest article or main element decides: what wraps it, whatever its name,
says nothing of the text in it, except where it is a place for comments or
other stories.  A name counts as whole words of one class or id; names such as
``with-sidebar`` describe a page's layout and do not count, and paragraphs and
other small elements count only if a class or id is such a word by itself.
If names leave no text at all, they are ignored.

Scripts, styles and other invisible elements never become blocks.  Nothing is
cut short: every block that the tree takes for main text is returned whole.

Defined results: a null or empty page, or one without main text, gives an
empty string and n_chars 0; a very long page is read whole, in one pass;
unclosed and misnested tags are repaired in the usual way; splits of the tree
that are equally good go to the first feature and the lowest threshold, and a
leaf with as many of either kind is no main text; repeated rows are each
extracted; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Elements whose content is no text, whose text is never the article's, and that end a block.
HIDDEN = frozenset("script style noscript template svg math canvas iframe object video audio select option textarea button head title datalist map".split())
AROUND = frozenset("nav footer aside form dialog menu header".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: First or last words of a class, an id or a role that name what is no main text, wherever it stands.
OTHER = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe subscription signup paywall comment comments commentlist disqus reply replies respond sidebar widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager menu nav navigation navbar toolbar complementary contentinfo".split())
#: The same, but only outside an article or main element.
OUTSIDE = frozenset("footer header masthead topbar copyright legal disclaimer skip login search follow tags colophon".split())
#: Places whose articles are no main text either.
OTHER_ARTICLES = frozenset("comment comments commentlist disqus replies respond related recommended recommendations".split())
#: Words that make a name speak of a page's layout or of a part of the text.
LAYOUT = frozenset("with has no without is not hide show open closed enabled disabled fixed sticky layout wrapper page body article entry post story content section main".split())
#: Elements for pieces of text; they are no main text only if a whole class or id says so.
SMALL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody table caption figcaption figure details summary hgroup".split()) | INLINE
SPACE = re.compile(r"[ \t\n\r\f\v   -     　\x1c-\x1f\x85]+")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|([^<]++|<)""", re.S)
MAIN_ROLE = re.compile(r"""\b(?:role|itemprop)\s*=\s*["']?(?:main|article|articlebody)\b""", re.I)
NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CONCEALED = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|\baria-hidden\s*=\s*["']?true|\bstyle\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: A start tag that ends these when they are open: the usual repairs.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    inside: bool  # an article or main element
    around: bool  # a navigation, footer or other element, or one so named
    named: bool = False  # it is only a name, or a form, that says so

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def says_other(tag: str, names: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's names say that it is no main text, and nor are articles in it."""
    other = articles = False
    for name in names.split():
        words = [w for w in re.split(r"[-_:.]+", name) if w]
        if not words:
            continue
        ends = {name} if tag in SMALL else {words[0], words[-1]}
        if not ends & OTHER and (inside or not ends & OUTSIDE):
            continue
        if len(words) > 1 and (words[0] in LAYOUT or words[-1] in LAYOUT) and not {words[-1]} & (OTHER_ARTICLES | {"ad", "ads"}):
            continue
        other = True
        articles = articles or bool(ends & OTHER_ARTICLES)
    return other, articles


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # (tag, hidden, kind); of inline elements only those that matter
    open_: dict[str, int] = {}
    text: list[str] = []
    linked = hidden = 0
    #: What the innermost open article says, and what was true outside it.  Kinds: 0 nothing, 1 no main text by its tag,
    #: 2 by its name, 3 by its name and so are articles in it, 4 an article.
    inside, tags, names_, closed = False, 0, 0, 0
    outer: list[tuple[bool, int, int]] = []

    def flush() -> None:
        nonlocal linked, text
        if text:
            joined = SPACE.sub(" ", "".join(text)).strip(" ")
            if joined:
                words = joined.count(" ") + 1
                by_tag = tags > 0
                out.append(Block(joined, words, min(linked, words), any(open_.get(t) for t in HEADINGS), inside, by_tag or names_ > 0 or closed > 0, not by_tag))
        text, linked = [], 0

    def push(tag: str, is_hidden: bool, kind: int) -> None:
        nonlocal hidden, inside, tags, names_, closed
        stack.append((tag, is_hidden, kind))
        open_[tag] = open_.get(tag, 0) + 1
        hidden += is_hidden
        if kind == 4:
            outer.append((inside, tags, names_))
            inside, tags, names_ = True, 0, 0
        tags += kind == 1
        names_ += kind == 2
        closed += kind == 3

    def pop(at: int = -1) -> None:
        nonlocal hidden, inside, tags, names_, closed
        tag, was_hidden, kind = stack.pop(at)
        open_[tag] -= 1
        hidden -= was_hidden
        if kind == 4:
            inside, tags, names_ = outer.pop()
        tags -= kind == 1
        names_ -= kind == 2
        closed -= kind == 3

    def top_inline(tag: str) -> int | None:
        """Place of ``tag`` in the stack if only inline elements are open inside it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                return k
            if stack[k][0] not in INLINE:
                return None
        return None

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        if (plain := m[5]) is not None or (plain := m[1]) is not None:
            if plain == "<" and at > last and re.match(r"/?[A-Za-z]", page[at : at + 2]):
                break  # a tag that the page's end cuts off
            if not hidden:
                text.append(html.unescape(plain) if m[1] is None and "&" in plain else plain)
                if open_.get("a"):
                    linked += len(plain.split())
            continue
        if m[3] is None:
            continue
        tag, attrs = m[3].lower(), m[4]
        if m[2]:
            if tag in ("p", "br"):
                flush()
            if not open_.get(tag):
                continue
            if tag in INLINE:
                if (k := top_inline(tag)) is not None or tag == "a":
                    pop(k if k is not None else max(k for k, x in enumerate(stack) if x[0] == tag))
                continue
            flush()
            while stack:
                t = stack[-1][0]
                pop()
                if t == tag:
                    break
            continue
        if open_.get("head") and tag not in IN_HEAD:  # a head that nothing closed
            while open_["head"]:
                pop()
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P and open_.get("p") and (k := top_inline("p")) is not None:
                pop(k)
            elif tag in ENDS and stack and stack[-1][0] in ENDS[tag]:
                pop()
        if tag in VOID:
            continue
        if tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template"):
            end = re.compile(rf"</{tag}[^>]*+>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        names = " ".join(x or y or z for x, y, z in NAMED.findall(attrs)).lower() if "=" in attrs else ""
        is_hidden = tag in HIDDEN or bool(attrs and CONCEALED.search(attrs))
        kind = 0
        if tag not in ("html", "body"):
            other, articles = says_other(tag, names, inside) if names else (False, False)
            if tag in MAIN or (attrs and MAIN_ROLE.search(attrs)):
                kind = 3 if other and articles else 2 if other else 0 if closed or open_.get("aside") else 4
            elif tag in AROUND and not (tag == "header" and inside):
                kind = 2 if tag == "form" else 1
            elif other:
                kind = 3 if articles else 2
        if tag == "a" and open_.get("a"):  # a link ends the one before it
            pop(max(k for k, x in enumerate(stack) if x[0] == "a"))
        if tag not in INLINE or tag == "a" or is_hidden or kind:
            push(tag, is_hidden, kind)
    flush()
    return out


# --- the tree ---------------------------------------------------------------------------------------------------------

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "inside", "around", "heading", "apart")  # apart: outside the page's articles
#: Labelled pages, a block each: its kind, its words, after a slash how many of them are linked, and + for main text.
#: Kinds: p a piece of text, h a heading, a and t the same inside an article; x and z the same in something around the
#: article, y and w in something of that sort inside it.
TABLE = """
x1/1- x1/1- x1/1- x9- t10+ a12+ a75+ a1+ a2+ a120/4+ x12-
x6/6- x2/2- t3+ a14+ a40+ a7+ a88+ a6+ y5- y44- y25- y8/8- p2/2- x20-
t11+ a300+ a95+ a10+ x10- x40- x25-
x9/9- p12- t2+ a60+ a22+ t4/4+ a35+ a20+ t6/6+ a51+ a3+ p40- p3/3- p2/2-
a30+ a24+ a7/7- a9/9- a3/3- a8/8- x7-
a44+ a20+ a5/5- a4/4- a6/6-
t6+ a12+ a3/3- a4/4- a5/5- a55+ a21+ a20/2+ a33/5+ a4/1+
t1+ a200+
a5+
a1+ a1+ a1+ t2+ a1+
t8+ a18/9+ a60+ a9/9+ a70+ a15/14+ a80+ a1/1+ a60+ x8-
p15- h9- t4+ a150+ a140+ a90+ a6+ p35- p80- p3- h2- p110-
x10- y110- t12+ a9+ y14- a130+ a100+ y65- a40+ y3- a12+
x1/1- x2/2- x1/1- h6+ p40+ p70+ p55/3+ p20+ p35+ x3/3- x12-
p2/2- p1/1- p3/3- p2/2- h8+ p70+ h3+ p22+ p28+ p60+ p20+ p3/3- p4/4- p6/6-
p1/1- p2/2- h5+ p90+ p9+ p50+ p4+ p62+ p24+ p6/6- p5/5- p7/7- p6-
p3/3- p2/2- p3- p2/2- p5- p4/4- h7+ p45+ p38+ p90/2+ x50- x12- x7-
p30+
p18+ p25+
p4+
h3+ p9+
h5+ p21+ p1+ p21+ p100+ p130/13+ p28+
p10/9- p9/9- p12/12- h6+ p33+ p16+ p2/2- p5/5- p12/12-
p25/20- p4/4- p20/18- p8/5- p3/3- p40+ p60+ p18+ p5/5- p12/12-
x22- x65- h9+ p80+ p11+ p95+ p2+ p110+ p12+ x100- x80-
x3/3- h4+ p20+ p20+ p20+ p20+ p2/2- p3/3- p1/1- x6-
x8- h2+ p150+ p17+ h4+ p25+ h5/5+ p40+ h3/3+ p19+ p7/7- p8/8-
t6+ a25+ a20+ t6/6+ a18+ a31+ t4/4+ a9+ t8/8+ a40+ a26+
t9+ a30+ a2/2+ a20+ a2/2+ a8+ a1/1+ a3+ t3/3+ a4+ z7/7- x20- z6/6- x15- z9- x30-
a20+ a6/6+ a20+ t5+ a10+ w5- y20- w4/4- y30- a25+ z8- x12- z5/5- x2/2-
h7+ p30+ p20+ h3/3+ p20+ p30+ h5/5+ p9+ p14+ z6/6- x20- z2- x6/6- x5/5-
h6+ p33+ p24+ p18+ h2/2+ p20+ h7/7+ p28+
p2/2- p2/2- h6+ p14+ p26+ p13+ p9+ p34+ x5-
"""
BLOCK = re.compile(r"([phatxzyw])(\d+)(?:/(\d+))?([+-])")


def features(found: list[Block]) -> list[tuple]:
    """The features of each block of a page."""
    article = any(b.inside for b in found)
    none = Block("", 0, 0, False, False, False)
    sides = zip([none, *found[:-1]], found, [*found[1:], none], strict=True) if found else ()
    return [(b.words, b.density, x.words, x.density, y.words, y.density, b.inside, b.around, b.heading, article and not b.inside) for x, b, y in sides]


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``TABLE``."""
    x, y = [], []
    for line in TABLE.split("\n"):
        parts = BLOCK.findall(line)
        x += features([Block("", int(n), int(m or 0), k in "htzw", k in "atyw", k in "xzyw") for k, n, m, _ in parts])
        y += [sign == "+" for *_, sign in parts]
    return np.array(x, float), np.array(y, int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 3) -> tuple | int:
    """A CART tree by Gini impurity, with ``least`` rows in a leaf: (feature, threshold, at most, above) or a class."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(2 * y.sum() > len(y))
    best = (np.inf, 0, 0.0)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, k] <= cut
            if min(low.sum(), (~low).sum()) < least:
                continue
            cost = sum(part.sum() * (1 - part.mean()) for part in (y[low], y[~low]))
            if cost < best[0] - 1e-12:
                best = (cost, k, float(cut))
    if best[0] >= y.sum() * (1 - y.mean()) - 1e-12:
        return int(2 * y.sum() > len(y))
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def train() -> tuple | int:
    return grow(*labelled())


def classify(tree: tuple | int, row: tuple) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def extract(page: str | None, tree: tuple | int) -> str:
    found = blocks(page or "")
    out = [b.text for b, row in zip(found, features(found), strict=True) if classify(tree, row)]
    if not out and any(b.around and b.named for b in found):
        for b in found:
            b.around = b.around and not b.named
        out = [b.text for b, row in zip(found, features(found), strict=True) if classify(tree, row)]
    return " ".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, tree) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))

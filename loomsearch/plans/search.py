"""The plan of a search: score, rerank, filter, and what is derived from the results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals
from ..functions.text import file_type, snippet
from ..operators import authority as links
from ..operators import results as R
from ..operators import suggest
from ..operators.index import Index, scored
from .lineage import cut
from .query import Options, Query, corrected, interpretation, parse, tokens


def ranked(index: Index, query: str, parsed: Query, as_of: Column, with_links: bool = True) -> DataFrame:
    """Documents with the query's terms, their signals and their total score; authority is taken among all of them."""
    terms = tokens(query)
    docs = scored(index, terms)
    if with_links:  # the link steps read the candidates several times: they are scored once, without their texts
        found = cut(docs.select("id", "url", "links", "base_score"))
        rank = links.authority(found.select("id", "url", "links"))
        docs = index.docs.join(found.select("id", "base_score").distinct().join(rank, "id"), "id").withColumn("authority_boost", F.col("authority") * 0.5).drop("authority")
    else:
        docs = docs.withColumn("authority_boost", F.lit(0.0))
    docs = docs.withColumns({"title_boost": signals.title_boost(terms, parsed.title_terms), "heading_boost": signals.heading_boost(terms), "description_boost": signals.description_boost(terms, parsed.url_terms), "phrase_boost": signals.phrase_boost(query, parsed.phrases), "freshness_boost": signals.freshness_boost(as_of)})
    names = ("base_score", "authority_boost", "heading_boost", "title_boost", "description_boost", "phrase_boost", "freshness_boost")
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    return docs.withColumn("score", F.round(total, 9))


def results(index: Index, query: str, parsed: Query, options: Options, as_of: Column, with_links: bool = True) -> DataFrame:
    """All results: matched, trusted, diversified; not yet ordered."""
    rows = ranked(index, query, parsed, as_of, with_links).where(R.matches(parsed))
    return R.filtered(rows.withColumn("trust", signals.trust()), options)


def presented(page: DataFrame, query: str, parsed: Query) -> DataFrame:
    """The rows of a page with what is shown of them; only these rows need their content."""
    shown = {"file_type": file_type(F.col("url")), "snippet": snippet(F.col("content"), query, tokens(query)), "site_links": R.site_links(), "match_context": R.match_context(parsed), "explanations": signals.explanations()}
    return page.withColumns(shown)


#: Code points of snippets that a summarizer is sent at most.
SUMMARY_CHARS = 1 << 20


@dataclass
class Response:
    """Scalars of a search and its tables, which are evaluated when they are asked for."""

    query: str
    normalized_query: str
    corrected_query: str
    interpretation: dict
    options: Options
    limit: int
    rows: DataFrame | None = None
    page: DataFrame | None = None
    count: int = 0
    has_more: bool = False
    cached: bool = False
    tables: dict[str, DataFrame] = field(default_factory=dict)
    answer: dict | None = None

    def release(self) -> None:
        """Frees what executors hold of it; its tables are evaluated anew when they are asked for again."""
        for df in (self.rows, self.page):
            if df is not None:
                df.unpersist()


def search(index: Index, query: str, limit: int = 10, options: Options | None = None, as_of: Column | None = None, summarize=None) -> Response:
    as_of = F.current_timestamp() if as_of is None else as_of
    limit = limit if limit > 0 else 10
    query = query.strip()
    parsed = parse(query)
    options = (options or Options()).normalized(parsed.site)
    normalized = suggest.correct(index.terms, parsed.cleaned) or parsed.cleaned
    out = Response(query, normalized, corrected(parsed.cleaned, normalized), interpretation(parsed, options), options, limit)
    if not query:
        return out
    rows = results(index, normalized, parsed, options, as_of).drop("terms", "links").cache()
    page = presented(R.page(rows, options, limit), normalized, parsed).cache()
    out.rows, out.page, out.count = rows, page, rows.count()
    out.has_more = options.offset + limit < out.count
    suggested = suggest.completions(index.terms, index.phrases, normalized, max(limit, 6))
    out.tables = {"domains": R.domain_facets(rows), "coverage": R.source_coverage(rows), "timeline": R.timeline(rows, as_of), "quality": R.quality(page), "highlights": R.highlights(page), "compare": R.compare_card(page, as_of), "related": suggest.related(normalized, page, suggested), "citations": R.citations(page)}
    shown = page.orderBy("pos").select("title", "url", "snippet").collect()  # one page
    if shown:
        snippets = [r["snippet"].strip() for r in shown if r["snippet"].strip()]
        points = snippets if summarize is None else evidence(rows, normalized, options)
        out.answer = answered(normalized, points, out.count, summarize) | {"citations": [{"title": r["title"], "url": r["url"]} for r in shown[:3]], "related_questions": people_also_ask(normalized, [r["title"] for r in shown])}
    return out


def evidence(rows: DataFrame, query: str, options: Options) -> list[str]:
    """The snippets of all results in order, as many as a summarizer's request of ``SUMMARY_CHARS`` takes."""
    out, size = [], 0
    for r in rows.select(*[F.col(c) for c in ("id", "score", "trust", "crawled_at")], snippet(F.col("content"), query, tokens(query)).alias("s")).orderBy(*R.order(options.sort_by)).select("s").toLocalIterator():
        size += len(r["s"])
        if size > SUMMARY_CHARS:
            break
        if r["s"].strip():
            out.append(r["s"].strip())
    return out


def answered(query: str, snippets: list[str], count: int, summarize=None) -> dict:
    """What ``summarize`` says of the results' snippets, or the plain summary without one or when it fails."""
    if summarize is not None:
        try:
            return summarize(query, snippets, count)
        except Exception:  # a service of others: the answer does not depend on it
            return summary(query, snippets, count) | {"generated": False}
    return summary(query, snippets, count)


def summary(query: str, points: list[str], count: int) -> dict:
    """A summary that quotes the first points."""
    points = [p.strip() for p in points if p.strip()][:3]
    text = f"Found {count} relevant snippets for '{query}'. Top evidence suggests: {' | '.join(points)}" if points else f"No grounded snippets are available yet for '{query}'."
    return {"query": query, "summary": text, "grounded_points": points, "generated": bool(points)}


def people_also_ask(query: str, titles: list[str]) -> list[str]:
    asked = [f"What is the best source for {query}?", f"How fresh are the results for {query}?"]
    if titles:
        asked.append(f"Why is {titles[0]} ranked first for {query}?")
    if len(titles) > 1:
        asked.append(f"Which result best explains {query}?")
    return asked[:4]

"""Text and url expressions; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple("a an and are as at be by for from has he in is it its of on that the to was were will with".split())
WHITE = " \t\n\r\x0b\x0c"
TRUSTED_HOSTS = ("gov", "edu", "org", "nih.gov", "cdc.gov", "who.int")


def lowered(text: Column) -> Column:
    """Lower case; the dotted capital I becomes one letter, not two."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def tokenize(text: Column) -> Column:
    """ASCII letter and digit runs of two or more, without stop words, in order and with repeats."""
    parts = F.split(F.regexp_replace(lowered(text), "[^a-z0-9]+", " "), " ")
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: inside a lambda it would be anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, least: int, most: int) -> Column:
    """Runs of ``least`` to ``most`` tokens joined by a space, shorter ones first."""

    def of(t: Column, n: int) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))

    return let(tokens, lambda t: F.concat(*[of(t, n) for n in range(least, most + 1)]))


def clean_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def host(url: Column) -> Column:
    """Lower-case host name, empty for urls without one."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def file_type(url: Column) -> Column:
    """Extension of the path in lower case; ``html`` for none, empty for an url that cannot be parsed."""
    path = F.lower(F.try_parse_url(url, F.lit("PATH")))
    found = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.when(path.isNull(), F.lit("")).when(found == "", F.lit("html")).otherwise(found)


def within_domain(domain: Column, site: str) -> Column:
    return (domain == site) | domain.endswith("." + site)


def trusted_host(url: Column) -> Column:
    h = host(url)
    out = F.lit(False)
    for suffix in TRUSTED_HOSTS:
        out = out | within_domain(h, suffix)
    return out


def fingerprint(title: Column, description: Column, content: Column) -> Column:
    return F.sha1(clean_space(F.concat_ws("\n", title, description, content)))


def snippet(content: Column, query: str, terms: list[str]) -> Column:
    """A window around the query, else around its first term that occurs, else the beginning."""
    text = F.btrim(content, F.lit(WHITE))
    low = lowered(text)
    end = F.length(text)

    def window(needle: str) -> Column:
        at = F.locate(needle, low) - 1
        start = F.greatest(at - 90, F.lit(0))
        stop = F.least(end, at + len(needle) + 150)
        body = F.btrim(F.substring(text, start + 1, stop - start), F.lit(WHITE))
        body = F.when(start > 0, F.concat(F.lit("..."), F.ltrim(body, F.lit(" .,")))).otherwise(body)
        return F.when(stop < end, F.concat(F.rtrim(body, F.lit(" .,")), F.lit("..."))).otherwise(body)

    needles = ([query.strip().lower()] if query.strip() else []) + terms
    out = F.when(end == 0, F.lit(""))
    for needle in needles:
        out = out.when(low.contains(needle), window(needle))
    return out.otherwise(F.when(end <= 200, text).otherwise(F.concat(F.btrim(F.substring(text, 1, 200), F.lit(WHITE)), F.lit("..."))))


def recrawl_days(joined: Column) -> Column:
    """Days until the next visit by the words of a page."""
    low = lowered(joined)
    return F.when(low.rlike("news|latest|update|release"), 1).when(low.rlike("blog|changelog|announc"), 3).when(low.rlike("guide|docs|reference|tutorial"), 21).otherwise(7)


def intent(query: Column) -> Column:
    """What a query is after, by its words; the first rule that fits decides."""
    low = F.lower(F.trim(query))
    told = F.regexp_replace(low, '"([^"]*)"', "$1")
    return (
        F.when(low.rlike(r"(^|\s)site:\S"), "navigational")
        .when(told.contains(" vs ") | told.contains("compare") | told.contains("best "), "comparison")
        .when(told.rlike("latest|today|new |news"), "freshness")
        .when(told.rlike("^(how|what|why|guide|tutorial) "), "informational")
        .when(low.rlike('"[^"]*[^"\\s][^"]*"'), "precision")
        .otherwise("exploration")
    )

"""Ranking signals, trust and explanations of a scored document, as expressions over its columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lowered


def _total(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def _if(hit: Column, weight: float) -> Column:
    return F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))


def title_boost(terms: list[str], title_terms: list[str]) -> Column:
    low = lowered(F.col("title"))
    return _total([_if(low.contains(t), 0.35) for t in terms] + [_if(low.contains(t), 0.5) for t in title_terms])


def heading_boost(terms: list[str]) -> Column:
    return _total([F.size(F.filter("headings", lambda h: lowered(h).contains(t))) * F.lit(0.22) for t in terms])


def description_boost(terms: list[str], url_terms: list[str]) -> Column:
    low = lowered(F.col("description"))
    return _total([_if(low.contains(t), 0.15) for t in terms] + [_if(lowered(F.col("url")).contains(t), 0.25) for t in url_terms])


def phrase_boost(query: str, phrases: list[str]) -> Column:
    title, content = lowered(F.col("title")), lowered(F.col("content"))
    either = lambda p, a, b: F.when(title.contains(p), F.lit(a)).when(content.contains(p), F.lit(b)).otherwise(F.lit(0.0))
    return _total([either(query.strip().lower(), 1.25, 0.65)] + [either(p, 0.55, 0.3) for p in phrases])


def age_hours(as_of: Column) -> Column:
    return (as_of.cast("double") - F.col("crawled_at").cast("double")) / 3600


def freshness_boost(as_of: Column) -> Column:
    age = age_hours(as_of)
    return F.when(age <= 24, 0.35).when(age <= 7 * 24, 0.2).when(age <= 30 * 24, 0.08).otherwise(0.0)


def freshness_label(as_of: Column) -> Column:
    age = age_hours(as_of)
    return F.when(age.isNull(), "undated").when(age <= 24, "today").when(age <= 7 * 24, "this week").when(age <= 30 * 24, "this month").otherwise("archived")


def trust() -> Column:
    """value, level and reason from the document and its title, phrase and description boosts."""
    size = F.octet_length("content")
    local = F.col("url").contains("127.0.0.1") | F.col("url").contains("localhost")
    rules = [
        (F.col("title") != "", 10, "clear title"), (F.col("description") != "", 8, "has description"), (size >= 160, 10, "substantial content"), (F.col("title_boost") > 0, 10, "query matches title"),
        (F.col("phrase_boost") > 0, 12, "phrase match found"), (F.col("description_boost") > 0, 5, None), (F.col("url").startswith("https://"), 5, "secure source"),
        (F.size("headings") > 0, 4, "structured headings"), (local, -8, "local development source"), (F.col("description") == "", -5, None), (size < 80, -10, None),
    ]
    value = F.lit(45)
    for hit, points, _ in rules:
        value = value + F.when(hit, points).otherwise(0)
    value = F.greatest(F.lit(0), F.least(F.lit(100), value))
    reasons = F.array_compact(F.array(*[F.when(hit, F.lit(text)) for hit, _, text in rules if text]))
    reason = F.when(F.size(reasons) == 0, "Limited page signals").otherwise(F.array_join(F.slice(reasons, 1, 2), ", "))
    return F.struct(value.alias("value"), trust_level(value).alias("level"), reason.alias("reason"))


def trust_level(value: Column) -> Column:
    return F.when(value >= 80, "high").when(value >= 65, "good").otherwise("review")


def trust_priority(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "good", 2).otherwise(1)


def two_places(x: Column) -> Column:
    """``x`` with two decimals, the exact binary value rounded half to even as C does."""
    exact = x.cast("decimal(38,30)")
    low = F.floor(exact * 100)
    rest = exact * 100 - low
    up = F.when(rest > F.lit("0.5").cast("decimal(38,30)"), 1).when((rest == F.lit("0.5").cast("decimal(38,30)")) & (low % 2 == 1), 1).otherwise(0)
    cents = (low + up).cast("long")
    return F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def explanations() -> Column:
    """(label, value) pairs in their fixed order."""
    note = lambda hit, label, value: F.when(hit, F.struct(F.lit(label).alias("label"), value.alias("value")))
    plus = lambda name, tail: F.concat(F.lit("+"), two_places(F.col(name)), F.lit(tail))
    return F.array_compact(F.array(
        note(F.lit(True), "Base rank", F.concat(two_places(F.col("base_score")), F.lit(" BM25-style score"))),
        note(F.col("authority_boost") > 0, "Authority", plus("authority_boost", " from linked-page authority")),
        note(F.col("heading_boost") > 0, "Heading match", plus("heading_boost", " from section-heading overlap")),
        note(F.col("title_boost") > 0, "Title match", plus("title_boost", " from title keyword overlap")),
        note(F.col("phrase_boost") > 0, "Phrase match", plus("phrase_boost", " from exact phrase relevance")),
        note(F.col("description_boost") > 0, "Description / URL", plus("description_boost", " from description and URL overlap")),
        note(F.size("headings") > 0, "Structure", F.concat(F.size("headings").cast("string"), F.lit(" extracted heading(s) available for sitelinks"))),
        note(F.col("description") == "", "Metadata gap", F.lit("Missing meta description lowers confidence")),
    ))


def strength() -> Column:
    rules = (("authority_boost", 0.35, "authority-heavy"), ("heading_boost", 0.4, "structured heading match"), ("freshness_boost", 0.2, "fresh coverage"), ("phrase_boost", 1.0, "tight phrase match"), ("title_boost", 0.7, "title-led relevance"))
    out = F.when(F.lit(False), "")
    for name, least, label in rules:
        out = out.when(F.col(name) >= least, label)
    return out.otherwise("balanced relevance")

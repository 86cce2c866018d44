"""Search queries: operators, options and intent.  Plain Python, since a query is a driver-side value."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from ..functions.text import STOP_WORDS

OPERATORS = ("site", "intitle", "inurl", "filetype", "after", "before")


def tokens(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.replace("İ", "i").lower()) if len(t) >= 2 and t not in STOP_WORDS]


def parse_date(raw: str) -> datetime | None:
    try:
        return datetime.strptime(raw, "%Y-%m-%d").replace(tzinfo=timezone.utc) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", raw) else None
    except ValueError:
        return None


def quoted_phrases(query: str) -> list[str]:
    pieces = query.split('"')
    return [p.strip() for p in pieces[1 : len(pieces) - 1 : 2] if p.strip()]


def intent_of(query: str, phrases: list[str], site: str) -> str:
    low = query.strip().lower()
    if site:
        return "navigational"
    if " vs " in low or "compare" in low or "best " in low:
        return "comparison"
    if any(w in low for w in ("latest", "today", "new ", "news")):
        return "freshness"
    if low.startswith(("how ", "what ", "why ", "guide ", "tutorial ")):
        return "informational"
    return "precision" if phrases else "exploration"


@dataclass(frozen=True)
class Query:
    cleaned: str = ""
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    title_terms: list[str] = field(default_factory=list)
    url_terms: list[str] = field(default_factory=list)
    file_types: list[str] = field(default_factory=list)
    after: datetime | None = None
    before: datetime | None = None
    site: str = ""
    intent: str = ""

    @property
    def advanced(self) -> bool:
        return bool(self.phrases or self.excluded or self.title_terms or self.url_terms or self.file_types or self.after or self.before or self.site)


def parse(query: str) -> Query:
    text = query.strip().lower()
    if not text:
        return Query()
    phrases = quoted_phrases(text)
    given: dict[str, list[str]] = {name: [] for name in OPERATORS}
    excluded, kept = [], []
    for word in text.split():
        name, colon, value = word.partition(":")
        if colon and value and name in given:
            given[name].append(value)
        elif word.startswith("-") and len(word) > 1:
            excluded.append(word[1:])
        elif not (word.startswith("-") or colon and name in given):
            kept.append(word.replace('"', "").replace("'", ""))
    for p in phrases:
        text = text.replace(f'"{p}"', p)
    cleaned = " ".join(" ".join(kept).split())
    types = [t.strip().removeprefix(".") for t in given["filetype"]]
    site = given["site"][-1].strip() if given["site"] else ""
    last = lambda name: parse_date(given[name][-1]) if given[name] else None
    return Query(cleaned, tokens(cleaned), phrases, excluded, tokens(" ".join(given["intitle"])), tokens(" ".join(given["inurl"])), list(dict.fromkeys(t for t in types if t)), last("after"), last("before"), site, intent_of(text, phrases, site))


@dataclass(frozen=True)
class Options:
    sort_by: str = "relevance"
    min_trust: int = 0
    domain: str = ""
    offset: int = 0
    trusted_only: bool = False

    def normalized(self, site: str = "") -> Options:
        trust = max(0, min(100, self.min_trust))
        return replace(self, sort_by=self.sort_by if self.sort_by in ("trust", "recent") else "relevance", min_trust=max(trust, 80) if self.trusted_only else trust, domain=(self.domain or site).strip().lower(), offset=max(0, self.offset))


def corrected(original: str, normalized: str) -> str:
    """The normalized query, if it is worth telling the user; else nothing."""
    return normalized if normalized and normalized != original.strip().lower() else ""


def interpretation(q: Query, o: Options) -> dict:
    day = lambda d: d.strftime("%Y-%m-%d") if d else ""
    return {"intent": q.intent, "phrases": q.phrases, "excluded_terms": q.excluded, "title_terms": q.title_terms, "url_terms": q.url_terms, "file_types": q.file_types, "after": day(q.after), "before": day(q.before), "site": q.site or o.domain, "has_advanced_ops": q.advanced or o.trusted_only or o.min_trust > 0 or bool(o.domain)}

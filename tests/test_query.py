from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomsearch.functions import text
from loomsearch.plans import query as Q


def test_operators():
    q = Q.parse('site:Example.com intitle:Premium inurl:search filetype:.PDF filetype:pdf after:2026-04-15 before:2026-04-19 "exact words" -ads guide\'s')
    assert (q.site, q.title_terms, q.url_terms, q.file_types) == ("example.com", ["premium"], ["search"], ["pdf"])
    assert (q.after, q.before) == (datetime(2026, 4, 15, tzinfo=timezone.utc), datetime(2026, 4, 19, tzinfo=timezone.utc))
    assert (q.phrases, q.excluded, q.cleaned) == (["exact words"], ["ads"], "exact words guides")
    assert q.advanced and q.intent == "navigational"


@pytest.mark.parametrize("raw", ["", "   "])
def test_blank(raw):
    assert Q.parse(raw) == Q.Query()


def test_bare_operators_and_lone_dash_are_dropped():
    q = Q.parse("site: - intitle: word")
    assert q.cleaned == "word" and not q.site and not q.title_terms


def test_last_date_wins_even_if_invalid():
    assert Q.parse("after:2026-04-01 after:2026-13-01 x").after is None
    assert Q.parse("after:2026-4-1 x").after is None


def test_unbalanced_quote_is_ignored():
    assert Q.quoted_phrases('"one two" and "three') == ["one two"]


@pytest.mark.parametrize(("raw", "intent"), [("go vs rust", "comparison"), ("best engine", "comparison"), ("latest engine", "freshness"), ("how it works", "informational"), ('"exact words" here', "precision"), ("plain words", "exploration"), ("site:a.org x", "navigational")])
def test_intent(raw, intent):
    assert Q.parse(raw).intent == intent


def test_intent_as_a_column_agrees(spark):
    raws = ["go vs rust", "best engine", "latest engine", "how it works", '"exact words" here', "plain words", "site:a.org x", 'a "" b', "site: x", "What Is This", 'the "best one" x']
    rows = spark.createDataFrame([(r,) for r in raws], "q string").select("q", text.intent(F.col("q"))).collect()
    assert [(r[0], r[1]) for r in rows] == [(r, Q.parse(r).intent) for r in raws]


def test_options_are_normalized():
    o = Q.Options("odd", 150, " Beta.Example.com ", -4, True).normalized()
    assert (o.sort_by, o.min_trust, o.domain, o.offset) == ("relevance", 100, "beta.example.com", 0)
    assert Q.Options(trusted_only=True).normalized().min_trust == 80
    assert Q.Options().normalized("a.org").domain == "a.org"


def test_corrected_only_when_it_differs():
    assert Q.corrected("premum searh", "premium search") == "premium search"
    assert Q.corrected("Premium", "premium") == ""

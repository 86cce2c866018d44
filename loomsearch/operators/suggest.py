"""Autocomplete, spelling correction and related queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokenize
from ..plans.query import tokens


def completions(terms: DataFrame, phrases: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """(value, n, words): terms and phrases that start with the prefix, best first.

    A one-word prefix puts all terms before all phrases; of several words only
    phrases with more words than the prefix are left.
    """
    prefix = prefix.strip().lower()
    limit = 5 if limit <= 0 else limit
    n_words = len(prefix.split())
    term = terms.where(F.col("term").startswith(prefix)).select(F.col("term").alias("value"), F.col("df").alias("n"), F.lit(1).alias("words"), F.lit(False).alias("phrase"))
    phrase = phrases.where(F.col("phrase").startswith(prefix)).select(F.col("phrase").alias("value"), F.col("freq").alias("n"), F.lit(n_words).alias("words"), F.lit(True).alias("phrase"))
    if n_words > 1:
        phrase = phrase.where(F.size(F.split("value", " ")) > n_words)
    both = term.unionByName(phrase)
    if not prefix:
        both = both.limit(0)
    first = F.desc("phrase") if n_words > 1 else F.asc("phrase")
    return both.orderBy(F.desc("words"), first, F.desc("n"), F.asc("value")).limit(limit).select("value", "n", "words")


def corrections(terms: DataFrame, query_tokens: list[str]) -> DataFrame:
    """(pos, token, best): the nearest vocabulary word within two edits, more frequent ones first, else the token.

    The few query tokens are the broadcast side.  A word whose length differs by
    more than two is out before any distance is computed.
    """
    spark = terms.sparkSession
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(query_tokens)], "pos int, token string")
    near = terms.join(F.broadcast(asked), F.abs(F.length("term") - F.length("token")) <= 2).withColumn("distance", F.levenshtein("term", "token", 2)).where(F.col("distance") >= 0)
    best = near.groupBy("pos").agg(F.min(F.struct("distance", (-F.col("df")).alias("rare"), "term")).alias("b")).select("pos", F.col("b.term").alias("term"))
    return asked.join(best, "pos", "left").select("pos", "token", F.coalesce("term", "token").alias("best"))


def correct(terms: DataFrame, query: str) -> str:
    """The corrected query; without tokens the query in lower case."""
    asked = tokens(query)
    if not asked:
        return query.strip().lower()
    return " ".join(r["best"] for r in sorted(corrections(terms, asked).collect(), key=lambda r: r["pos"]))  # a row for each query token


def distinct_suggestion(query: str, candidate: Column) -> Column:
    """True for candidates worth showing beside the query."""
    query = query.strip().lower()
    own, words = tokens(query), len(query.split())
    found = tokenize(candidate)
    fine = (candidate != "") & (candidate != query) & (F.size(found) > 0)
    if words > 1:
        fine = fine & (F.size(found) > words)
    return fine & ~F.coalesce(found == F.array(*[F.lit(t) for t in own]).cast("array<string>"), F.lit(False))


def related(query: str, page: DataFrame, suggested: DataFrame, limit: int = 6) -> DataFrame:
    """(phrase, score): suggestions and phrases of the page's titles and descriptions, scored and summed."""
    from_list = suggested.select(F.lower(F.trim("value")).alias("phrase"), F.lit(6).alias("score"))
    own = F.concat(ngrams(tokenize(F.col("title")), 2, 3), ngrams(tokenize(F.col("description")), 2, 3))
    shared = F.size(F.filter(F.split("phrase", " "), lambda t: t.isin(*tokens(query)) if tokens(query) else F.lit(False)))
    from_page = page.select(F.explode(own).alias("phrase")).select("phrase", (2 + shared).alias("score"))
    both = from_list.unionByName(from_page).where(distinct_suggestion(query, F.col("phrase")))
    return both.groupBy("phrase").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "phrase").limit(limit)

"""Ingest: duplicates, upserts, recrawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import recrawl_days


def first_by_fingerprint(batch: DataFrame) -> DataFrame:
    """``batch`` with ``first_id``: the id that ingest order (``seq``) puts first among equal fingerprints.

    An aggregate instead of a window, so that one very common text is combined
    before the exchange.
    """
    first = batch.where("content_fingerprint <> ''").groupBy("content_fingerprint").agg(F.min(F.struct("seq", "id")).alias("f")).select("content_fingerprint", F.col("f.id").alias("first_id"))
    return batch.join(first, "content_fingerprint", "left")


def duplicates(batch: DataFrame, store: DataFrame) -> DataFrame:
    """(url, canonical_url, id): rows whose text the store or an earlier row of the batch has under another id."""
    known = store.where("content_fingerprint <> ''").groupBy("content_fingerprint").agg(F.max_by(F.struct("id", "url"), F.struct("crawled_at", "id")).alias("k"))
    rows = first_by_fingerprint(batch).join(known, "content_fingerprint", "left")
    urls = batch.groupBy(F.col("id").alias("first_id")).agg(F.min_by("url", "seq").alias("first_url"))
    rows = rows.join(urls, "first_id", "left")
    in_store, in_batch = F.coalesce(F.col("k.id") != F.col("id"), F.lit(False)), F.coalesce(F.col("first_id") != F.col("id"), F.lit(False))
    return rows.where(in_store | in_batch).select("url", F.when(in_store, F.col("k.url")).otherwise(F.col("first_url")).alias("canonical_url"), "id")


def accepted(batch: DataFrame, store: DataFrame) -> DataFrame:
    """The rows of ``batch`` that are no duplicates, the last of each id."""
    return latest(batch.join(duplicates(batch, store).select("id", "url").distinct(), ["id", "url"], "left_anti"), "id", F.col("seq"))


def latest(rows: DataFrame, key: str, by: Column) -> DataFrame:
    """The last row of each key by ``by``, nulls first; rows are combined before the exchange, so that no key is too hot."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, F.struct(by.alias("by"))).alias("__row")).select("__row.*")


def latest_by_fingerprint(store: DataFrame) -> DataFrame:
    return store.where("content_fingerprint <> ''").groupBy("content_fingerprint").agg(F.max_by("id", F.struct("crawled_at", "id")).alias("id"))


def upsert(store: DataFrame, batch: DataFrame) -> DataFrame:
    return store.join(batch.select("id"), "id", "left_anti").unionByName(batch.select(*store.columns))


def stale(docs: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """Documents due for another visit, longest overdue first; a limit of 0 or less means all."""
    due = docs.where(F.col("recrawl_after") <= as_of)
    rows = due.select("id", "url", "title", "crawled_at", "recrawl_after", F.floor((as_of.cast("double") - F.col("recrawl_after").cast("double")) / 3600).cast("long").alias("staleness_hours")).orderBy("recrawl_after", "url", "id")
    return rows.limit(limit) if limit > 0 else rows


def recrawl_after(fetched_at: Column) -> Column:
    joined = F.concat_ws(" ", "url", "title", "description", F.array_join("headings", " "), "content")
    return fetched_at + F.make_dt_interval(days=recrawl_days(joined))


def expanded(roots: DataFrame, found: DataFrame, cap: int = 25) -> DataFrame:
    """(url, root, discovered): roots and what was found under them, at most ``cap`` each, the first of equal urls."""
    own = roots.select("root", "root_pos", F.lit(0).alias("pos"), F.col("root").alias("url"))
    rows = own.unionByName(found.join(roots, "root").select("root", "root_pos", (F.col("pos") + 1).alias("pos"), "url"))
    w = Window.partitionBy("root").orderBy("pos", "url")
    rows = rows.groupBy("root", "root_pos", "url").agg(F.min("pos").alias("pos")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    first = rows.groupBy("url").agg(F.min(F.struct("root_pos", "pos", "root")).alias("f"))
    return first.select("url", F.col("f.root").alias("root"), (F.col("url") != F.col("f.root")).alias("discovered"))


def blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Urls (url, host, path) that a rule (host, disallow) forbids by prefix; empty rules forbid nothing."""
    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    return urls.join(rules.where("disallow <> ''"), (urls["host"] == rules["host"]) & path.startswith(F.col("disallow")), "left_semi")

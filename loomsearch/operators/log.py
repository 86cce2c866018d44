"""Query-log analytics and replay of the result cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 120


def analytics(log: DataFrame) -> DataFrame:
    """One row: totals, hit rate, average latency and the last query's figures; negative latencies count as 0 in the average."""
    last = F.max_by(F.struct("latency_ms", "cache_hit", "at"), F.struct("at", "query"))
    rows = log.agg(F.count(F.lit(1)).alias("total_queries"), F.count_if("cache_hit").alias("cache_hits"), F.sum(F.greatest("latency_ms", F.lit(0))).alias("ms"), last.alias("last"))
    total = F.greatest("total_queries", F.lit(1))
    return rows.select("total_queries", "cache_hits", F.round(F.col("cache_hits") / total, 6).alias("cache_hit_rate"), F.round(F.coalesce("ms", F.lit(0)) / total, 6).alias("average_ms"), F.col("last.latency_ms").alias("last_latency_ms"), F.col("last.cache_hit").alias("last_cache_hit"), F.col("last.at").alias("last_query_at"))


def top_queries(log: DataFrame, limit: int = 6) -> DataFrame:
    rows = log.select(F.trim(F.lower("query")).alias("query")).where("query <> ''")
    return rows.groupBy("query").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "query").limit(limit)


def replay(log: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """(key, at, hit): whether each request found the answer that the last miss had filled in.

    A hit does not extend an entry's life, so the requests of a key are a chain
    that is walked in time order.  After a stretch of time of the length ``ttl``
    without a request of the key, the next one is a miss whatever came before:
    chains are cut there, and their parts walked in different tasks, in sorted
    batches that carry only the time of the last miss.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, filled = (None, None), 0.0
        for pdf in batches:
            hits = []
            for *k, at in zip(pdf["key"], pdf["chain"], pdf["seconds"], strict=True):
                if k == key and at - filled <= ttl:
                    hits.append(True)
                else:
                    key, filled = k, at
                    hits.append(False)
            yield pdf[["key", "at"]].assign(hit=hits)

    rows = log.select("key", "at", F.col("at").cast("timestamp").cast("double").alias("seconds"), F.xxhash64("key", "at").alias("tie"))
    kind = log.schema["at"].dataType.simpleString()
    rows = rows.withColumn("slot", F.floor(F.col("seconds") / ttl))
    # (key, slot) with requests, combined before the exchange; a slot opens a chain if the one before it has none
    slots = rows.select("key", "slot").distinct()
    w = Window.partitionBy("key").orderBy("slot")
    opens = F.when(F.lag("slot").over(w) == F.col("slot") - 1, None).otherwise(F.col("slot"))
    chains = slots.withColumn("opens", opens).select("key", "slot", F.last("opens", ignorenulls=True).over(w).alias("chain"))
    rows = rows.join(chains, ["key", "slot"])
    return rows.repartition("key", "chain").sortWithinPartitions("key", "chain", "seconds", "tie").mapInPandas(run, f"key string, at {kind}, hit boolean")

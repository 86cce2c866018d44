"""Record types of the engine."""

from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType(), False)

DOCUMENT = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("url", T.StringType(), False), T.StructField("domain", T.StringType(), False),
    T.StructField("title", T.StringType(), False), T.StructField("description", T.StringType(), False), T.StructField("content", T.StringType(), False),
    T.StructField("terms", TEXTS, False), T.StructField("links", TEXTS, False), T.StructField("headings", TEXTS, False),
    T.StructField("content_fingerprint", T.StringType(), False), T.StructField("crawled_at", T.TimestampType()), T.StructField("recrawl_after", T.TimestampType()),
])

QUERY_LOG = T.StructType([
    T.StructField("query", T.StringType(), False), T.StructField("latency_ms", T.LongType(), False), T.StructField("cache_hit", T.BooleanType(), False), T.StructField("at", T.TimestampType(), False),
])

JOB = T.StructType([
    T.StructField("job_id", T.StringType(), False), T.StructField("status", T.StringType(), False), T.StructField("urls", TEXTS, False), T.StructField("error", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType()),
])

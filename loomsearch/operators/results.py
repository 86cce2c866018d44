"""Filters, orders, pages and summaries of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import freshness_label, strength, trust_priority
from ..functions.text import file_type, lowered, trusted_host, within_domain
from ..plans.query import Options, Query

PER_DOMAIN = 2


def matches(q: Query) -> Column:
    """All operators of the query as one predicate over documents."""
    text = lowered(F.concat_ws(" ", "title", "description", "content"))
    out = F.lit(True)
    if q.site:
        out = out & within_domain(F.col("domain"), q.site)
    for p in q.phrases:
        out = out & text.contains(p)
    for t in q.title_terms:
        out = out & lowered(F.col("title")).contains(t)
    for t in q.url_terms:
        out = out & lowered(F.col("url")).contains(t)
    if q.file_types:
        out = out & file_type(F.col("url")).isin(*q.file_types)
    if q.after:
        out = out & F.coalesce(F.col("crawled_at") >= F.lit(q.after), F.lit(False))
    if q.before:
        out = out & F.coalesce(F.col("crawled_at") < F.lit(q.before) + F.expr("INTERVAL 1 DAY"), F.lit(False))
    for t in q.excluded:
        out = out & ~text.contains(t)
    return out


def accepted(o: Options) -> Column:
    out = F.col("trust.value") >= o.min_trust if o.min_trust > 0 else F.lit(True)  # all values are 0 or more
    if o.domain:
        out = out & within_domain(F.col("domain"), o.domain)
    return out & trusted_host(F.col("url")) if o.trusted_only else out


def order(sort_by: str) -> list[Column]:
    first = {"trust": [F.desc("trust.value")], "recent": [F.desc_nulls_last("crawled_at")]}.get(sort_by, [])
    return [*first, F.desc("score"), F.asc("id")]


def diversified(results: DataFrame, per_domain: int = PER_DOMAIN) -> DataFrame:
    """The best few of each domain; rows without a domain all stay."""
    alone = F.when(F.col("domain") == "", F.monotonically_increasing_id())  # in one reading: each row without a domain is a group of its own
    w = Window.partitionBy("domain", "alone").orderBy(F.desc("score"), F.asc("id"))
    named = results.where("domain IS NOT NULL").withColumn("alone", alone)
    return named.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_domain).drop("rn", "alone")


def filtered(results: DataFrame, o: Options) -> DataFrame:
    results = results.where(accepted(o))
    return diversified(results) if o.sort_by == "relevance" and not o.domain else results


def page(results: DataFrame, o: Options, limit: int) -> DataFrame:
    """One page in order, with ``pos`` from 0; only the rows up to its end are ever sorted together."""
    top = results.orderBy(*order(o.sort_by)).limit(o.offset + limit)
    w = Window.orderBy(*order(o.sort_by))
    return top.withColumn("pos", F.row_number().over(w) - 1 - o.offset).where("pos >= 0")


def match_context(q: Query) -> Column:
    """Why a document matched, four entries at most."""
    hit = lambda test, text: F.when(F.coalesce(test, F.lit(False)), F.lit(text))
    title, content = lowered(F.col("title")), lowered(F.col("content"))
    fixed = [hit(file_type(F.col("url")) == t, f"Filetype matched {t}") for t in q.file_types]
    if q.after:
        fixed.append(hit(F.col("crawled_at") >= F.lit(q.after), f"After filter matched {q.after:%Y-%m-%d}"))
    if q.before:
        fixed.append(hit(F.col("crawled_at") < F.lit(q.before) + F.expr("INTERVAL 1 DAY"), f"Before filter matched {q.before:%Y-%m-%d}"))
    fixed += [hit(content.contains(p) | title.contains(p), f"Exact phrase: {p}") for p in q.phrases]
    fixed += [hit(title.contains(t), f"Title operator matched {t}") for t in q.title_terms]
    fixed += [hit(lowered(F.col("url")).contains(t), f"URL operator matched {t}") for t in q.url_terms]
    before = F.array_compact(F.array(*fixed)) if fixed else F.array().cast("array<string>")

    def touched(h: Column) -> Column:
        out = F.lit(False)
        for t in q.terms:
            out = out | lowered(h).contains(t)
        return out

    heads = F.transform(F.filter("headings", touched), lambda h: F.concat(F.lit("Heading hit: "), h))
    every = F.concat(before, heads)
    early = (F.size(before) < 4) & (F.size(every) >= 4)  # a heading that makes it four ends the list at once, repeats and all
    return F.when(early, F.slice(every, 1, 4)).otherwise(F.slice(F.array_distinct(every), 1, 4))


def site_links() -> Column:
    return F.slice("headings", 1, 3)


# --- summaries --------------------------------------------------------------------------------------------------------


def domain_facets(results: DataFrame) -> DataFrame:
    return results.where("domain <> ''").groupBy("domain").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "domain")


def source_coverage(results: DataFrame, limit: int = 5) -> DataFrame:
    """(domain, count, average_trust, top_title) of the largest sources; the average is cut to a whole number."""
    named = results.withColumn("domain", F.when(F.col("domain") == "", "(unknown)").otherwise(F.col("domain")))
    best = F.max_by("title", F.struct(F.col("title") != "", "score", F.col("trust.value"))).alias("top_title")
    rows = named.groupBy("domain").agg(F.count(F.lit(1)).alias("count"), F.expr("sum(trust.value) div count(1)").alias("average_trust"), best)
    return rows.orderBy(F.desc("count"), F.desc("average_trust"), "domain").limit(limit)


def timeline(results: DataFrame, as_of: Column) -> DataFrame:
    """(bucket, count) of four ages, always all four; undated rows are the oldest."""
    spark = results.sparkSession
    names = ["Past day", "Past week", "Past month", "Older"]
    age = (as_of.cast("double") - F.col("crawled_at").cast("double")) / 3600
    of = F.when(age <= 24, 0).when(age <= 7 * 24, 1).when(age <= 30 * 24, 2).otherwise(3)
    counts = results.groupBy(of.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    buckets = spark.createDataFrame(list(enumerate(names)), "k int, bucket string")
    return buckets.join(counts, "k", "left").orderBy("k").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def quality(page_rows: DataFrame) -> DataFrame:
    """One row: average_trust, top_trust_level, trusted_results, needs_review."""
    level = F.col("trust.level")
    best = F.max(trust_priority(level))
    return page_rows.agg(
        F.coalesce(F.expr("sum(trust.value) div count(1)"), F.lit(0)).cast("long").alias("average_trust"),
        F.when(best == 3, "high").when(best == 2, "good").otherwise("review").alias("top_trust_level"),
        F.count_if(level.isin("high", "good")).alias("trusted_results"),
        F.count_if(~level.isin("high", "good")).alias("needs_review"),
    )


def highlights(page_rows: DataFrame, limit: int = 3) -> DataFrame:
    counts = page_rows.select(F.explode("explanations.label").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(limit).select("label", "n", F.format_string("%s across %d result(s)", "label", "n").alias("highlight"))


def compare_card(page_rows: DataFrame, as_of: Column) -> DataFrame:
    """The first three rows of a page side by side; nothing for fewer than two."""
    one_page = Window.partitionBy(F.lit(0))  # a second reading of the page would search again
    rows = page_rows.withColumn("several", F.count(F.lit(1)).over(one_page) >= 2).where("pos < 3 AND several")
    return rows.orderBy("pos").select("pos", "title", "domain", strength().alias("strength"), F.col("trust.value").alias("trust"), freshness_label(as_of).alias("freshness"))


def citations(page_rows: DataFrame) -> DataFrame:
    return page_rows.where("pos < 3").orderBy("pos").select("pos", "title", "url")

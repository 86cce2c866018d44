"""The corpus pipeline: each stage works on what the one before it wrote.

Quality rules and language identification drop the documents that they reject,
near-duplicate detection keeps one document of each group, personal data is
generalised in the texts, and what is left is packed into sequences.

Defined results: a document with a null or empty text fails the quality rules'
fixed limits and goes; a very long text passes each stage whole; of repeated
rows and of a group of near copies the one with the smallest doc_id stays, nulls
last; without labels only the fixed limits decide, and without documents of a
known language none is rejected for its language; all columns of documents,
also such with names that a stage uses inside, come through every stage but the
last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomsearch.llm import langid, packing, pii, quality, resemblance
from loomsearch.llm.common import discard, read, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resemblance.keep_one(docs)


def pii_sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, packing.vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_sanitised", pii_sanitised),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules, parse tables and tokenisers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again.

    The output of the stage before goes as soon as the next one's is complete.
    """
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)

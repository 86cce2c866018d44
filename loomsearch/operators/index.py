"""The inverted index as tables, and BM25 over them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .phrases import phrase_count, phrase_stats

K1, B = 1.5, 0.75


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf)."""
    return docs.select("id", F.explode("terms").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(docs: DataFrame) -> DataFrame:
    """(id, dl): documents without terms count with length 0."""
    return docs.select("id", F.size("terms").cast("long").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms").cast("double")).alias("avgdl"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df): the vocabulary, without building postings first."""
    return docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def index_stats(docs: DataFrame) -> DataFrame:
    terms = term_stats(docs).agg(F.count(F.lit(1)).alias("terms"))
    return docs.agg(F.count_distinct("id").alias("documents")).crossJoin(terms).crossJoin(phrase_count(docs))  # one row each


@dataclass
class Index:
    """The tables of one corpus; build once, write where many searches follow.

    Tables that are not ``stored`` are plans over the documents: whoever reads
    the rows of a term in them reads all texts.
    """

    docs: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    corpus: DataFrame
    terms: DataFrame
    phrases: DataFrame
    stored: bool = False

    @classmethod
    def of(cls, docs: DataFrame) -> Index:
        return cls(docs, postings(docs), doc_stats(docs), corpus_stats(docs), term_stats(docs), phrase_stats(docs))

    def write(self, path: str) -> Index:
        """Writes the tables, postings clustered by term so that a term filter skips row groups, and reads them back."""
        spark = self.docs.sparkSession
        tables = {"docs": self.docs, "postings": self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "doc_stats": self.doc_stats, "corpus": self.corpus, "terms": self.terms.repartitionByRange("term").sortWithinPartitions("term"), "phrases": self.phrases.repartitionByRange("phrase").sortWithinPartitions("phrase")}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        return Index(**{name: spark.read.parquet(f"{path}/{name}") for name in tables}, stored=True)

    @cached_property
    def unique(self) -> bool:
        """Whether each document has an id of its own; reads the ids alone."""
        return self.docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty()


def bm25(index: Index, terms: list[str]) -> DataFrame:
    """(id, score) of documents with any of the terms; a repeated term counts again."""
    times = Counter(terms)
    if not times:
        return index.docs.sparkSession.createDataFrame([], "id string, score double")
    if not index.stored and index.unique:
        return _by_row(index.docs, times).select("id", F.col("base_score").alias("score"))
    weight = F.element_at(F.create_map(*[x for t, n in times.items() for x in (F.lit(t), F.lit(float(n)))]), F.col("term"))
    hits = index.postings.where(F.col("term").isin(*times))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each query term
    stats = F.broadcast(df.crossJoin(index.corpus))  # as many rows again
    rows = hits.join(stats, "term").join(index.doc_stats, "id")
    return rows.groupBy("id").agg(F.sum(weight * _part(F.col("tf"), F.col("df"), F.col("dl"))).alias("score"))


def scored(index: Index, terms: list[str]) -> DataFrame:
    """The documents with any of the terms, and their ``base_score``.

    A stored index joins the scores with the documents by id.  Without one all
    texts are read anyway: each row counts the terms in itself, first for the
    corpus's one row of counts, then for its score, and nothing is exchanged.
    """
    times = Counter(terms)
    if times and not index.stored and index.unique:
        return _by_row(index.docs, times)
    return bm25(index, terms).withColumnRenamed("score", "base_score").join(index.docs, "id")


def _part(tf: Column, df: Column, dl: Column) -> Column:
    idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _by_row(docs: DataFrame, times: Counter) -> DataFrame:
    tf = [f"tf{k}" for k in range(len(times))]
    counts = [(F.size("terms") - F.size(F.array_remove("terms", t))).alias(n) for t, n in zip(times, tf, strict=True)]
    one = docs.select("*", F.explode(F.array(F.lit(0))).alias("one"))  # a generator of one row: what filters ask of the terms does not split the texts again
    rows = one.select(*docs.columns, F.size("terms").alias("dl"), *counts)
    stats = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.col("dl").cast("double")).alias("avgdl"), *[F.count_if(F.col(n) > 0).alias(f"df{n}") for n in tf])
    parts = [F.when(F.col(n) > 0, F.lit(float(w)) * _part(F.col(n), F.col(f"df{n}"), F.col("dl"))).otherwise(F.lit(0.0)) for n, w in zip(tf, times.values(), strict=True)]
    found = rows.where(reduce(Column.__or__, [F.col(n) > 0 for n in tf])).crossJoin(F.broadcast(stats))
    return found.select(*docs.columns, reduce(Column.__add__, parts).alias("base_score"))


#: Segments of a stored index that are read together at most; more are merged into one.
MAX_SEGMENTS = 8


class IndexStore:
    """An index in a folder, built once and added to by segments.

    A segment holds the documents of one batch, their postings clustered by
    term, the ids that it replaces, and what it changes of the counts of terms,
    phrases and documents.  Reading unites the segments; a replaced document's
    rows are those of an earlier segment than that which names its id.  So a
    batch costs what it holds, not what the corpus does.  A segment counts once
    its last table is complete; a batch that is repeated replaces its own
    documents and has the same effect.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = MAX_SEGMENTS) -> None:
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def segments(self) -> list[int]:
        """The complete segments since the last merged one, in order."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        of = jvm.org.apache.hadoop.fs.Path
        names = sorted((int(n[1:]), n[0]) for n in (x.getPath().getName() for x in fs.listStatus(root)) if n[0] in "sm" and n[1:].isdigit() and fs.exists(of(f"{self.path}/{n}/corpus/_SUCCESS")))
        first = max((k for k, (_, kind) in enumerate(names) if kind == "m"), default=0)
        self.kinds = {n: kind for n, kind in names[first:]}
        return list(self.kinds)

    def _read(self, table: str, segments: list[int]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{self.kinds[n]}{n}/{table}").withColumn("segment", F.lit(n)) for n in segments]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, rows: DataFrame, segments: list[int]) -> DataFrame:
        if len(segments) == 1:
            return rows.drop("segment")
        dead = self._read("dead", segments).groupBy("id").agg(F.max("segment").alias("until"))
        return rows.join(dead, (rows["id"] == dead["id"]) & (rows["segment"] < dead["until"]), "left_anti").drop("segment")

    def docs(self) -> DataFrame | None:
        segments = self.segments()
        return self._live(self._read("docs", segments), segments) if segments else None

    def index(self) -> Index:
        segments = self.segments()
        live = lambda table: self._live(self._read(table, segments), segments)
        total = lambda table, key, n: self._read(table, segments).groupBy(key).agg(F.sum(n).alias(n)).where(F.col(n) > 0)
        corpus = self._read("corpus", segments).agg(F.sum("n_docs").alias("n_docs"), (F.sum("length") / F.sum("n_docs")).alias("avgdl"))
        return Index(live("docs"), live("postings"), live("doc_stats"), corpus, total("terms", "term", "df"), total("phrases", "phrase", "freq"), stored=True)

    def append(self, new: DataFrame) -> None:
        """Adds documents, one for each id; those of known ids replace the old ones."""
        segments, old = self.segments(), self.docs()
        gone = new.limit(0) if old is None else old.join(new.select("id"), "id", "left_semi").select(*new.columns)
        self._write(f"s{(segments[-1] if segments else 0) + 1}", new, gone)
        if len(segments) + 1 > self.most:
            self.merge()

    def merge(self) -> None:
        """Writes all segments as one."""
        docs = self.docs()
        self._write(f"m{self.segments()[-1] + 1}", docs, docs.limit(0))

    def _write(self, name: str, new: DataFrame, gone: DataFrame) -> None:
        def change(of: Callable[[DataFrame], DataFrame], key: str, n: str) -> DataFrame:
            both = of(new).unionByName(of(gone).withColumn(n, -F.col(n)))
            return both.groupBy(key).agg(F.sum(n).alias(n)).where(F.col(n) != 0).repartitionByRange(key).sortWithinPartitions(key)

        count = lambda docs: docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("l"))
        tables = {
            "docs": new, "postings": postings(new).repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "doc_stats": doc_stats(new), "dead": gone.select("id"), "terms": change(term_stats, "term", "df"),
            "phrases": change(phrase_stats, "phrase", "freq"), "corpus": count(new).crossJoin(count(gone).toDF("gone_n", "gone_l")).select((F.col("n") - F.col("gone_n")).alias("n_docs"), (F.col("l") - F.col("gone_l")).alias("length")),
        }
        for table, df in tables.items():  # the last one makes the segment count
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/{table}")


def upsert(index_docs: DataFrame, new: DataFrame) -> DataFrame:
    """Documents after ``new`` replaced or joined those of the same id."""
    return index_docs.join(new.select("id"), "id", "left_anti").unionByName(new)

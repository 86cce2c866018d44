"""A crawl queue over a folder of request files, and documents kept current by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import accepted, duplicates
from ..sources.stores import ParquetStore

REQUEST = "job_id string, url string, html string, requested_at timestamp"


def ingest(spark: SparkSession, requests: str, store: ParquetStore, jobs: str, checkpoint: str, to_documents: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Reads request files (job_id, url, html) as they arrive; every micro-batch upserts its new documents.

    A batch writes a job row with its counts or its error.  An empty page is an
    issue of its url and does not stop the others.  A batch that fails stops the
    stream once its job row says why: the checkpoint repeats it, so that no page
    is lost.  It then finds its documents in the store under the same ids and
    writes them again, so that it has the same effect.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch, failure = batch.persist(), None
        try:
            fine = batch.where("html <> ''")
            docs = to_documents(fine)
            order = fine.select(F.col("url").alias("asked"), F.struct("requested_at", "url").alias("seq")).dropDuplicates(["asked"])
            docs = docs.join(order, docs["url"] == order["asked"], "left").drop("asked")
            old = store.scan()
            known = old if old is not None else docs.drop("seq").limit(0)
            copies = duplicates(docs, known).count()
            new = accepted(docs, known).drop("seq")
            store.save(new)
            row = batch.groupBy("job_id").agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.coalesce(F.col("html"), F.lit("")) == "").alias("issues"))
            row = row.withColumns({"status": F.lit("completed"), "error": F.lit(""), "duplicates": F.lit(copies), "epoch": F.lit(epoch)})
        except Exception as e:
            failure = e
            row = batch.groupBy("job_id").agg(F.count(F.lit(1)).alias("urls"), F.lit(0).cast("long").alias("issues"))
            row = row.withColumns({"status": F.lit("failed"), "error": F.lit(str(e)[:500]), "duplicates": F.lit(0), "epoch": F.lit(epoch)})
        row.write.mode("overwrite").json(f"{jobs}/epoch={epoch}")
        batch.unpersist()
        if failure is not None:
            raise failure

    stream = spark.readStream.schema(REQUEST).json(requests)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_terms(spark: SparkSession, folder: str, schema: str, checkpoint: str, out: str) -> StreamingQuery:
    """Document counts of terms in event-time windows of a document stream; late documents are dropped after a day."""
    docs = spark.readStream.schema(schema).parquet(folder).withWatermark("crawled_at", "1 day")
    counts = docs.select("crawled_at", F.explode(F.array_distinct("terms")).alias("term")).groupBy(F.window("crawled_at", "1 day"), "term").agg(F.count(F.lit(1)).alias("df"))
    return counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

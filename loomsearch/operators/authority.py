"""Link authority: eight damped steps over the links among the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

STEPS, DAMPING = 8, 0.85


def edges(docs: DataFrame) -> DataFrame:
    """(src, dst) among ``docs``; a link that is given twice counts twice, links to itself do not count."""
    links = docs.select(F.col("id").alias("src"), F.explode("links").alias("url"))
    return links.join(docs.select("url", F.col("id").alias("dst")), "url").where("src != dst").select("src", "dst")


def authority(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """(id, authority): scores with maximum 1; documents without links share their score with all."""
    links = cut(edges(docs))
    fan = links.groupBy("src").agg(F.count(F.lit(1)).alias("fan"))
    nodes = cut(docs.select("id").join(fan, F.col("id") == F.col("src"), "left").select("id", "fan"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("authority"))
    rank = nodes.withColumn("score", F.lit(1.0 / n))
    for step in range(steps):
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("fan").isNull(), F.col("score"))), F.lit(0.0)).alias("loose"))
        given = rank.where("fan is not null").select(F.col("id").alias("src"), (F.lit(DAMPING) * F.col("score") / F.col("fan")).alias("share"))
        got = given.join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        rank = nodes.join(got, "id", "left").crossJoin(F.broadcast(loose)).select("id", "fan", (F.lit((1 - DAMPING) / n) + F.lit(DAMPING / n) * F.col("loose") + F.coalesce("got", F.lit(0.0))).alias("score"))
        if step % 4 == 3:
            rank = cut(rank)
    top = rank.agg(F.max("score").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("authority"))

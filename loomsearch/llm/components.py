"""Connected components of links, distributed and inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of ``i`` and ``j`` pairwise; ``root`` maps each place to the smallest of its class."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _stars(links: DataFrame) -> DataFrame:
    """One round of the large-star and small-star steps on (u, v) links with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") > F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return small.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v) but the roots, the smallest node of each component.

    Alternates the large-star and small-star steps until nothing changes; each
    round is written to the shared folder, so that lineage does not grow.
    Every step is a join or an aggregate by node: links of a node with very
    many of them are aggregated before the exchange or split by the skew join.
    Defined results: links from a node to itself, repeated ones and null ends
    are ignored; no links give no rows.
    """
    links = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    links, last = stored(links, "links")
    before = tuple(links.agg(*mark).first())
    while before[0]:
        links, path = stored(_stars(links), "stars")
        discard(links.sparkSession, last)
        now, last = tuple(links.agg(*mark).first()), path
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))

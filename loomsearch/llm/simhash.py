"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Two fingerprints within ``RADIUS`` = 3 bits agree on at least one of any four
blocks into which the 64 bits are cut.  Each distinct fingerprint is dealt out
once for each of four blocks, by the block's place and value.  Inside a bucket
the fingerprints are sorted by Gray rank; runs of 8, 64, 512, ... neighbours
become nodes that hold the bits on which all of the run agree.  A node keeps
only what its parent does not hold, so that a query going down adds up its
differences and leaves a whole run as soon as they exceed the radius.

A bucket that holds more than a fair share of rows is dealt out again by four
blocks of the bits that are still free, which keeps the guarantee; this goes
on until no bucket is too large, or fewer bits are free than blocks.  No pair
of linked fingerprints is lost, and a task emits a spanning forest of what it
links, not all pairs.

Defined results: a null or empty text has no shingle and fingerprint zero,
which links like any other; texts of one or two words have one shingle; a very
long text is hashed whole; a bit that half of the hashes have is 0;
component_id is the smallest doc_id of the component, null only if all of them
are null; repeated rows each come back; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_row, materialize, read, shuffle_width, small_side, whole_text
from .components import components, merge

RADIUS, BLOCKS, FAN = 3, 4, 8
#: Rows of a bucket that are never thought too many, and rows that a task is planned for.
FAIR_ROWS, TASK_ROWS = 600, 200_000


# --- fingerprints -----------------------------------------------------------------------------------------------------


def shingle_hashes(text: str, size: int) -> np.ndarray:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space is \x20 \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        parts = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
        parts = [joined[a:b] for a, b in zip(starts, ends[size - 1 :], strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, 42) for p in parts), np.uint64, len(parts))


def fold(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, size: int = 3) -> int:
    return fold(shingle_hashes(text or "", size))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(t, size)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


# --- the index --------------------------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def index_levels(first: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From the top: (starts, residual mask, pattern) of the nodes; ``first`` is each place's bucket start."""
    n, place = len(fps), np.arange(len(fps)) - first
    spans = [1]
    while spans[-1] <= (place.max() if n else 0):
        spans.append(spans[-1] * FAN)
    levels, held, parent = [], None, None
    for span in reversed(spans):
        starts = np.flatnonzero(place % span == 0)
        all_of, any_of = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
        mask = ~(all_of ^ any_of)
        left = mask if held is None else mask & ~held[np.searchsorted(parent, starts, "right") - 1]
        levels.append((starts, left, all_of & mask))
        held, parent = mask, starts
    return levels


def linked_pairs(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of fingerprints of one bucket within ``radius``; both arrays are sorted by bucket and Gray rank."""
    n = len(fps)
    if not n:
        return
    opens = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[opens, n])
    first = np.repeat(opens, sizes)
    levels = index_levels(first, fps)
    queries = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    if not len(queries):
        return
    work = np.cumsum(np.repeat(sizes, sizes)[queries])
    cuts = np.searchsorted(work, np.arange(chunk, work[-1] + chunk, chunk), "right")
    for a, b in zip(np.r_[0, cuts[:-1]], cuts, strict=True):
        q = queries[a:b]
        if not len(q):
            continue
        node = np.searchsorted(levels[0][0], first[q])
        far = np.zeros(len(q), np.int64)
        for depth, (starts, mask, pattern) in enumerate(levels):
            far = far + np.bitwise_count((fps[q] ^ pattern[node]) & mask[node])
            last = np.r_[starts[1:], n][node] - 1
            stay = (far <= radius) & (last > q)  # only partners that come later
            q, node, far = q[stay], node[stay], far[stay]
            if depth + 1 < len(levels):
                below = levels[depth + 1][0]
                lo, hi = np.searchsorted(below, starts[node]), np.searchsorted(below, np.r_[starts[1:], n][node])
                q, far = np.repeat(q, hi - lo), np.repeat(far, hi - lo)
                node = np.arange(len(q)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        yield q, levels[-1][0][node]


def forest(mask: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the links that the buckets ``mask``, ``fps & mask`` show."""
    value = fps & mask
    order = np.lexsort((gray_rank(fps), value, mask))
    mask, value, fps = mask[order], value[order], fps[order]
    bucket = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]) if len(fps) else mask
    same, where = np.unique(fps, return_inverse=True)
    root = np.arange(len(same))
    for i, j in linked_pairs(bucket, fps):
        merge(root, where[i], where[j])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return same[moved], same[root[moved]]


def split_mask(mask: int) -> list[int]:
    """Four masks that each add one block of the free bits to ``mask``."""
    free = [k for k in range(64) if not mask >> k & 1]
    cut = [len(free) * k // BLOCKS for k in range(BLOCKS + 1)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def dealt(fps: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(mask, fp) rows such that fingerprints within the radius meet in some bucket (mask, fp & mask), and their number."""
    spark = fps.sparkSession
    masks, out, total = {0}, None, 0
    rows = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    width = shuffle_width(spark, n * BLOCKS, TASK_ROWS)
    while True:
        children = {m: split_mask(m) for m in masks}
        table = F.create_map(*[x for m, c in children.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in c]))])
        rows = rows.select(F.explode(F.element_at(table, F.col("mask"))).alias("mask"), "fp")
        masks = {k for c in children.values() for k in c}
        last = all(64 - m.bit_count() < 2 * BLOCKS for m in masks)
        value = F.col("fp").bitwiseAND(F.col("mask"))
        fair = max(FAIR_ROWS, n * BLOCKS // width)
        counts = materialize(rows.groupBy("mask", value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "buckets")
        hot = counts.where(F.col("n") > fair).select(F.col("mask").alias("hot_mask"), F.col("value").alias("hot_value"))
        n_hot = 0 if last else hot.count()
        total += counts.agg(F.sum("n")).first()[0] or 0
        if n_hot:
            on = (F.col("mask") == F.col("hot_mask")) & (value == F.col("hot_value"))
            side = small_side(hot, n_hot)
            cool, rows = rows.join(side, on, "left_anti"), materialize(rows.join(side, on, "left_semi"), "hot")
        else:
            cool = rows
        out = cool if out is None else out.unionByName(cool)
        if not n_hot:
            return out, total
        masks = {m & ((1 << 64) - 1) for m in (r[0] for r in rows.select("mask").distinct().collect())}  # at most 4 to the power of the level


def links(fps: DataFrame, n: int) -> DataFrame:
    """A spanning forest (u, v) of the fingerprints ``fp`` within the radius of each other; ``n`` is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        u, v = forest(*[np.concatenate([np.empty(0, np.int64), *[b.column(k).to_numpy(zero_copy_only=False) for b in got]]).astype(np.int64).view(np.uint64) for k in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], names=["u", "v"])

    rows, total = dealt(fps, n)
    width = shuffle_width(fps.sparkSession, total, TASK_ROWS)
    return rows.repartition(width, "mask", F.col("fp").bitwiseAND(F.col("mask"))).mapInArrow(run, "u long, v long")


# --- the operator -----------------------------------------------------------------------------------------------------


def cluster(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, root): the fingerprint of each row and the root fingerprint of its component."""
    prints = materialize(fingerprints(docs, size), "fingerprints")
    distinct = materialize(prints.select("fp").distinct(), "distinct-fingerprints")
    found = components(links(distinct, distinct.count()))
    joined = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return joined.select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.result(cluster(docs, size), "clusters")
    # written, so that the join has exchanges of its own, of which a very large component's can be split
    ids = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return rows.join(ids, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 3) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component, one for each; of repeated rows, one."""
    with Scratch(docs.sparkSession) as scratch:
        return keep_least(docs, cluster(docs, size), scratch)


def keep_least(docs: DataFrame, clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of ``docs`` for each root of ``clusters`` (doc_id, text_hash, root): the one with the smallest doc_id."""
    rows = materialize(clusters, "clusters")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_hash"))).alias("b")
    kept = rows.groupBy("root").agg(best).select(F.col("b.doc_id").alias("__id"), F.col("b.text_hash").alias("__h"))
    times = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("__n")).select(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__k"), "__n")
    kept = kept.join(times, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__k"))).drop("__i", "__k").distinct()
    kept = scratch.result(kept, "kept")
    docs = as_row(docs, "doc_id", F.xxhash64(whole_text()).alias("__k"))
    own = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__h"))
    once = docs.join(kept.where("__n = 1"), own, "left_semi").select("__row.*")
    if not kept.where("__n > 1").limit(1).count():
        return once
    again = docs.join(kept.where("__n > 1"), own, "left_semi").dropDuplicates(["doc_id", "__k"]).select("__row.*")
    return once.unionByName(again)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))

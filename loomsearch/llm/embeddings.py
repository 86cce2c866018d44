"""Near-duplicate vectors by collision counts on one-dimensional projections.

Vectors are compared within a label and a length only.  Equal vectors form one
class, so that copies cost nothing.  Each of ``TABLES`` tables has many random
lines.  In a table, a unit vector takes part in one line only, that on which it
lies furthest out, at one of its two ends: it stands in a short sorted run of
vectors that do so too.  In the run, a window around the query's value collides
with its partners.  Close vectors collide in most tables, others in hardly any,
since each line's end holds a small share of the vectors; there are more lines
where there are more vectors, so that runs stay short.

For unit vectors with cosine s, values on random lines are normal with
correlation s whatever the vectors' length, so that the probability of a
collision at the threshold is found once by simulation, and binomial
distributions give the count that a pair must reach to be a candidate, and the
number of tables whose runs are searched, such that either misses at most
``MISS`` of the pairs at the very threshold.  Collisions in all tables are
counted from the line numbers that each row carries.

A task emits a spanning forest of its candidates.  The vectors of one component
of candidates come together once, large ones in pairs of blocks, and there all
are compared in double precision: nothing below the threshold is linked, and
what the counts missed inside a component is found.

Defined results: a vector that is null, zero, or holds a null, NaN or infinite
component, or whose label is null, has n_links 0 and its own vec_id as
component_id; vectors of different lengths never link; repeated rows are
vectors of their own; very long vectors are like any other; a tie of two lines
goes to the first; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, read, runs, shuffle_width, small_side
from .components import components, merge

THRESHOLD = 0.93
TABLES, WIDTH, MISS, SEED = 32, 2.0, 1e-4, 7
#: Lines of a table at least, mean rows of a run that the number of lines is chosen for, rows of a run that is not cut, and of a block.
LINES, RUN_ROWS, WHOLE_RUN, BLOCK_ROWS = 8, 512, 8192, 4096
TASK_ROWS = 200_000


# --- calibration ------------------------------------------------------------------------------------------------------


def half_window(threshold: float) -> float:
    return WIDTH * math.sqrt(2 - 2 * threshold)


@cache
def collision_rate(lines: int, threshold: float, pairs: int = 20_000) -> float:
    """How often a pair at the threshold lies in the same run of a table, within the window."""
    rng, hits, step = np.random.default_rng(SEED), 0, max(1, (1 << 20) // lines)
    for k in range(0, pairs, step):
        x = rng.standard_normal((min(step, pairs - k), lines), np.float32)
        y = threshold * x + math.sqrt(1 - threshold * threshold) * rng.standard_normal(x.shape, np.float32)
        (a, u), (b, v) = furthest(x), furthest(y)
        hits += int(((a == b) & (np.abs(u - v) <= half_window(threshold))).sum())
    return hits / pairs


def least_count(rate: float, tables: int = TABLES, miss: float = MISS) -> int:
    """The largest number of collisions that a pair at the threshold reaches with probability 1 - miss or more; at least one."""
    below, k = 0.0, 0
    while k < tables:
        below += math.comb(tables, k) * rate**k * (1 - rate) ** (tables - k)
        if below > miss:
            break
        k += 1
    return max(k, 1)


def searched_tables(rate: float, tables: int = TABLES, miss: float = MISS) -> int:
    """Tables such that a pair at the threshold collides in one of them with probability 1 - miss or more."""
    return tables if rate <= 0 else 1 if rate >= 1 else min(tables, max(1, math.ceil(math.log(miss) / math.log(1 - rate))))


def lines_for(rows: int, run_rows: int = RUN_ROWS) -> int:
    """Lines of a table, a power of two, such that ``rows`` vectors make runs of at most ``run_rows`` on average."""
    return max(LINES, 1 << max(0, math.ceil(math.log2(max(rows, 1) / (2 * run_rows)))))


# --- runs -------------------------------------------------------------------------------------------------------------


def furthest(shadow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The line end (twice the line, and one more for the positive end) and the value there, along the last axis."""
    at = np.abs(shadow).argmax(-1)
    value = np.take_along_axis(shadow, at[..., None], -1)[..., 0]
    return (2 * at + (value > 0)).astype(np.int32), np.abs(value)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; they are scaled first, so that no square is too large or too small."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


@cache
def directions(size: int, lines: int, tables: int = TABLES) -> np.ndarray:
    return np.random.default_rng((SEED, size)).standard_normal((size, tables * lines), np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def sketches(classes: DataFrame, lines: int, searched: int) -> DataFrame:
    """(label, size, node, ends, values): line ends in all tables as bytes, and values in those searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column(1).to_numpy()
            for size in np.unique(sizes).tolist():
                b = whole.filter(pa.array(sizes == size))
                step = max(1, (1 << 22) // (TABLES * lines))
                for k in range(0, b.num_rows, step):
                    part = b.slice(k, step)
                    shadow = unit(matrix(part.column(3))).astype(np.float32) @ directions(size, lines)
                    ends, values = furthest(shadow.reshape(part.num_rows, TABLES, lines))
                    values = pa.FixedSizeListArray.from_arrays(pa.array(values[:, :searched].ravel(), pa.float32()), searched).cast(pa.list_(pa.float32()))
                    wide = ends.astype("<u4" if 2 * lines > 1 << 16 else "<u2" if lines > 128 else "u1")
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([r.tobytes() for r in wide], pa.binary()), values], names=["label", "size", "node", "ends", "values"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "size", "node", "embedding").mapInArrow(run, f"label {kind}, size int, node long, ends binary, values array<float>")


def dealt(sketched: DataFrame, lines: int, whole_run: int, scratch: Scratch) -> DataFrame:
    """(cell, side, value, node, ends): rows of the runs; a long run is cut into blocks, and each two of them are a cell."""
    width = 4 if 2 * lines > 1 << 16 else 2 if lines > 128 else 1
    end = F.substring("ends", F.col("table") * width + 1, F.lit(width))
    rows = sketched.select("label", "size", "node", "ends", F.posexplode("values").alias("table", "value"))
    rows = rows.select(F.xxhash64("label", "size", "table", end).alias("run"), "node", "ends", "value")
    long_ = sketched.select("label", "size", "ends", F.posexplode("values").alias("table", "value")).groupBy(F.xxhash64("label", "size", "table", end).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    long_ = scratch.keep(long_.where(F.col("n") > whole_run).select("run", F.ceil(F.col("n") / whole_run).cast("int").alias("blocks")), "long-runs")
    n_long = long_.count()
    if not n_long:
        return rows.select(F.col("run").alias("cell"), F.lit(0).alias("side"), "value", "node", "ends")
    rows = rows.join(small_side(long_, n_long), "run", "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    rows = rows.select("run", "value", "node", "ends", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
    cell = F.when(F.col("other").isNotNull(), F.xxhash64("run", F.least("own", "other"), F.greatest("own", "other")))
    return rows.select(cell.alias("cell"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "value", "node", "ends")


def collisions(value: np.ndarray, ends: np.ndarray, sides: np.ndarray, half: float, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of a run, sorted by side and value, within the window and with ``need`` line ends in common."""
    cut = int(np.searchsorted(sides, 1))
    same = cut == len(value)  # else one of the rows is of the first block and the other of the second
    a, b = (0, len(value)), (0, len(value)) if same else (cut, len(value))
    a = a if same else (0, cut)
    for k in range(a[0], a[1], 256):
        m = min(k + 256, a[1])
        lo = k if same else b[0] + int(np.searchsorted(value[b[0] : b[1]], value[k] - half, "left"))
        hi = b[0] + int(np.searchsorted(value[b[0] : b[1]], value[m - 1] + half, "right"))
        if lo >= hi:
            continue
        count = np.zeros((m - k, hi - lo), np.uint8)
        for t in range(ends.shape[1]):
            count += ends[k:m, t, None] == ends[None, lo:hi, t]
        near = (count >= need) & (np.abs(value[k:m, None] - value[None, lo:hi]) <= half)
        i, j = np.nonzero(near)
        i, j = i + k, j + lo
        yield (i[i < j], j[i < j]) if same else (i, j)


def candidates(rows: DataFrame, n: int, lines: int, half: float, need: int) -> DataFrame:
    """A spanning forest (u, v) of the candidates that each run shows."""
    kind = np.dtype("<u4" if 2 * lines > 1 << 16 else "<u2" if lines > 128 else "u1")
    rows = rows.repartition(shuffle_width(rows.sparkSession, n, TASK_ROWS), "cell").sortWithinPartitions("cell", "side", "value", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for b in runs(batches, "cell"):
            if b.num_rows < 2:
                continue
            node = b.column(3).to_numpy()
            ends = np.frombuffer(b"".join(b.column(4).to_pylist()), kind).reshape(b.num_rows, -1)
            root = np.arange(b.num_rows)
            for i, j in collisions(b.column(2).to_numpy(), ends, b.column(1).to_numpy(), half, need):
                merge(root, i, j)
            moved = np.flatnonzero(root != np.arange(len(root)))
            u.append(node[moved])
            v.append(node[root[moved]])
            if sum(map(len, u)) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v)], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (u, v)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


# --- verification -----------------------------------------------------------------------------------------------------


def compared(b: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, n): the classes of two blocks with links to others, a spanning forest of the links, and the linked vectors."""
    node, times, side = b.column("node").to_numpy(), b.column("times").to_numpy(), b.column("side").to_numpy()
    rows, root, n = unit(matrix(b.column("embedding"))), np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
    cut = int(np.searchsorted(side, 1))
    same = b.column("low")[0] == b.column("high")[0]
    first, last = (0, b.num_rows) if same else (0, cut)
    for k in range(first, last, 512):
        m = min(k + 512, last)
        lo = k if same else cut
        near = rows[k:m] @ rows[lo:].T >= threshold
        if same:
            near &= np.arange(lo, b.num_rows)[None] > np.arange(k, m)[:, None]
        n[k:m] += near @ times[lo:]
        n[lo:] += times[k:m] @ near
        i, j = np.nonzero(near)
        merge(root, i + k, j + lo)
    some = (n > 0) | (root != np.arange(len(root)))
    return node[some], node[root[some]], n[some]


def links(members: DataFrame, classes: DataFrame, threshold: float, block_rows: int, scratch: Scratch) -> DataFrame:
    """(node, root, n) of the classes that are linked, from the components (node, root) of candidates."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = scratch.keep(sizes.where(F.col("n") > block_rows).select("root", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "large-components")
    rows = members.join(small_side(large, large.count()), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", "node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    rows = rows.join(classes.select("node", F.xxhash64("label", "size").alias("kind"), "size", "times", "embedding"), "node")
    keys = ["root", "low", "high", "kind", "size"]
    rows = rows.repartition(shuffle_width(rows.sparkSession, members.count(), TASK_ROWS), *keys[:3]).sortWithinPartitions(*keys, "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, *keys):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in compared(b, threshold)], names=["node", "root", "n"])

    return rows.mapInArrow(run, "node long, root long, n long")


# --- the operator -----------------------------------------------------------------------------------------------------


def valid() -> Column:
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & v.isNotNull() & fine & some, F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, whole_run: int = WHOLE_RUN, run_rows: int = RUN_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)).alias("embedding"))  # -0.0 is 0.0
    key = ("label", F.size("embedding"), "embedding")
    rows = rows.withColumn("ok", valid())
    rows = rows.select("vec_id", "ok", "label", "embedding", *[F.when(F.col("ok"), F.xxhash64(F.lit(k), *key)).alias(f"h{k}") for k in (0, 1)])  # 128 bits tell classes apart
    one = rows.where("ok").groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("first"), F.first(F.struct("label", "embedding")).alias("o"))
    classes = one.select(F.monotonically_increasing_id().alias("node"), "h0", "h1", "times", "first", "o.label", F.size("o.embedding").alias("size"), "o.embedding")
    classes = scratch.keep(classes, "embedding-classes")
    n = classes.count()
    lines = lines_for(classes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0, run_rows)
    rate = collision_rate(lines, threshold)
    searched, need = searched_tables(rate), least_count(rate)
    sketched = scratch.keep(sketches(classes, lines, searched), "embedding-sketches")
    forest = scratch.keep(candidates(dealt(sketched, lines, whole_run, scratch), n * searched, lines, half_window(threshold), need), "embedding-candidates")
    found = scratch.keep(components(forest), "embedding-groups")
    members = scratch.keep(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "embedding-members")
    linked = scratch.keep(links(members, classes, threshold, block_rows, scratch), "embedding-links")
    roots = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    n_links = linked.groupBy("node").agg(F.sum("n").alias("n"))
    own = classes.select("node", "h0", "h1", "first", "times").join(n_links, "node", "left").join(roots, "node", "left")
    own = own.select("h0", "h1", F.coalesce("root", "node").alias("root"), "first", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    own = scratch.keep(own, "embedding-counts")
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    own = materialize(own.join(least, "root").select("h0", "h1", "n_links", "component_id"), "embedding-results")
    scratch.drop()
    out = rows.select("vec_id", "h0", "h1").join(own, ["h0", "h1"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))

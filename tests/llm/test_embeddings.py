import math

import numpy as np
import pytest

from loomsearch.llm import embeddings

from .helpers import SMALL, as_folder, needs_tables

SCHEMA = "vec_id long, embedding array<float>, label int, node long, size int, line double, times int, root string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2, 0.5, 3, "r", 4) for i, v, label in rows], SCHEMA)


def brute(rows, threshold=0.93):
    """vec_id, n_links, component_id by comparing all pairs."""
    good = {}
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            x = np.array(v, np.float32).astype(float)
            if x.any():
                good[k] = x / np.sqrt((x * x).sum())
    links, root = {k: 0 for k in range(len(rows))}, {k: k for k in range(len(rows))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold - 1e-15:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, links[k], least[find(k)]) for k, (i, *_) in enumerate(rows))


def got(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect())


def test_edges_against_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, 0), (2, 0), (1, 0.1), (0, 0), (nan, 1), (inf, 1), (None, 1), None, (), (-1, 0), (1, 0, 0), (0.0, -0.0), (1, -0.0), (3e38, 3e38), (1e-38, 1e-38), (1, 0.395), (1, 0.396)]
    rows = [(k + 10, v, 1) for k, v in enumerate(vectors)] + [(50, (1, 0), None), (51, (1, 0), 2), (52, (1, 0), 2)]
    out = embeddings.near_duplicates(table(spark, rows))
    assert got(out) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out.collect())


@pytest.mark.parametrize("limits", [{}, {"block_rows": 16, "whole_run": 20}, {"block_rows": 64, "whole_run": 7, "run_rows": 4}])
def test_clusters_against_brute_force(spark, limits):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    rows = []
    for k in range(500):
        c = centres[rng.integers(30)]
        rows.append((k, tuple((c + rng.standard_normal(24) * rng.choice([0.05, 0.25, 0.3, 1.0])).astype(np.float32).tolist()), int(rng.integers(2)) if k % 50 else None))
    rows += [(500 + k, rows[7][1], rows[7][2]) for k in range(40)]
    assert got(embeddings.near_duplicates(table(spark, rows), **limits)) == brute(rows)


@needs_tables
def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert got(embeddings.op10_embedding_near_dedup(spark, SMALL)) == brute(rows)


@pytest.mark.parametrize("lines", [8, 64, 256])
@pytest.mark.parametrize("size", [16, 64])
def test_recall_at_the_threshold(lines, size):
    """Pairs at the very threshold, counted with the shipped tables: as few are missed as calculated."""
    rate = embeddings.collision_rate(lines, 0.93)
    need, searched, half = embeddings.least_count(rate), embeddings.searched_tables(rate), embeddings.half_window(0.93)
    rng = np.random.default_rng(5)
    a = embeddings.unit(rng.standard_normal((4000, size)))
    b = rng.standard_normal((4000, size))
    b = embeddings.unit(b - (a * b).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    lie = lambda x: embeddings.furthest((x.astype(np.float32) @ embeddings.directions(size, lines)).reshape(len(x), embeddings.TABLES, lines))
    (x, u), (y, v) = lie(a), lie(b)
    meet = (x == y)[:, :searched] & (np.abs(u - v)[:, :searched] <= half)
    missed = ~(meet.any(1) & ((x == y).sum(1) >= need))
    assert need > 1 and missed.sum() <= 4


def test_collisions_count_all_tables():
    rng = np.random.default_rng(1)
    for sides in (np.zeros(60, int), np.repeat([0, 1], [25, 35])):
        value = rng.random(60)
        value = np.concatenate([np.sort(value[sides == 0]), np.sort(value[sides == 1])])
        ends = rng.integers(0, 3, (60, 9))
        got = {(i, j) for x, y in embeddings.collisions(value, ends, sides, 0.2, 4) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
        pairs = [(i, j) for i in range(60) for j in range(i + 1, 60) if not sides.any() or sides[i] != sides[j]]
        assert got == {(i, j) for i, j in pairs if abs(value[i] - value[j]) <= 0.2 and (ends[i] == ends[j]).sum() >= 4}


def test_double_precision(spark):
    """Vectors of doubles are compared as such: these cosines differ from the threshold by less than a float shows."""
    s = 0.93
    rows = [(1, [1.0, 0.0], 1), (2, [s + 1e-9, math.sqrt(1 - (s + 1e-9) ** 2)], 1), (3, [1.0, 0.0], 2), (4, [s - 1e-9, math.sqrt(1 - (s - 1e-9) ** 2)], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(embeddings.near_duplicates(df)) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def test_one_large_group(spark):
    """A third of all rows close to each other, all of them different."""
    rng = np.random.default_rng(9)
    far = rng.standard_normal((600, 32))
    near = rng.standard_normal(32) + rng.standard_normal((300, 32)) * 0.1
    rows = [(k, tuple(x.astype(np.float32).tolist()), 1) for k, x in enumerate(np.concatenate([far, near]))]
    assert got(embeddings.near_duplicates(table(spark, rows), block_rows=64, whole_run=50)) == brute(rows)


def test_empty_repeats_and_null_ids(spark, tmp_path):
    rows = [(1, (1, 0), 1), (1, (1, 0), 1), (None, (0, 1), 1)]
    df = table(spark, rows)
    assert embeddings.near_duplicates(df).count() == 3
    assert sorted(r["n_links"] for r in embeddings.near_duplicates(df).collect()) == [0, 1, 1]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(table(spark, [(1, None, 1), (2, (), None)])).count() == 2
    assert embeddings.op10_embedding_near_dedup(spark, as_folder(tmp_path, embeddings=df)).count() == 3

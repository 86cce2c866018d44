import random
import re

import numpy as np
import pytest
import xxhash

from loomsearch.llm import simhash

from .helpers import SMALL, as_folder, documents, needs_tables, rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in SPACE.split(low) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = {f: f for f in set(fps)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps, strict=True):
        least[find(f)] = min(least.get(find(f), i), i)
    return {i: least[find(f)] for i, f in zip(ids, fps, strict=True)}


def near(rng, f, bits):
    for b in rng.sample(range(64), bits):
        f ^= 1 << b
    return f


TEXTS = [None, "", " \n\x0b", "one", "One", "a b", "a b c", "A B C", "a b c d", "é x y", "a b c a b c a b c", "w " * 5000, " ".join(f"w{i}" for i in range(20000)), "\x85 \x1f x", "a b c"]


def test_edges_against_brute_force(spark):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, *TEXTS, first=5)).collect()}
    fps = [brute_fingerprint(t) for t in TEXTS]
    want = brute_components(range(5, 5 + len(TEXTS)), fps)
    assert {k: r["fingerprint"] for k, r in got.items()} == {k + 5: f"{f:016x}" for k, f in enumerate(fps)}
    assert {k: r["component_id"] for k, r in got.items()} == want


@needs_tables
def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op9_simhash_near_dedup(spark, SMALL.replace("0.001", "0.01")).collect()}
    fps = [brute_fingerprint(r["text"]) for r in docs]
    want = brute_components([r["doc_id"] for r in docs], fps)
    assert got == {r["doc_id"]: (f, want[r["doc_id"]]) for r, f in zip(docs, fps, strict=True)}


@pytest.mark.parametrize("seed", range(4))
def test_all_links_are_found(spark, seed, monkeypatch):
    """Also where a bucket is far too full, so that it is dealt out again."""
    monkeypatch.setattr(simhash, "FAIR_ROWS", 40)
    rng = random.Random(seed)
    crowd = rng.getrandbits(64)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [near(rng, rng.choice(fps), rng.randint(1, 4)) for _ in range(300)]
    fps += [(crowd & ~0xFFFF) | rng.getrandbits(16) for _ in range(300)] + [near(rng, crowd, rng.randint(0, 6)) for _ in range(300)]
    fps += [0, (1 << 64) - 1, 1, 1 << 63, 7, 15]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    from loomsearch.llm.components import components

    found = {r["node"]: r["root"] for r in components(simhash.links(df, len(fps))).collect()}
    groups = lambda pairs: {frozenset(g) for g in pairs.values()}
    got, want = {}, {}
    for f in fps:
        got.setdefault(found.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
    for f, r in brute_components(fps, fps).items():
        want.setdefault(r, set()).add(f)
    assert groups(got) == groups(want)


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_exactly_the_pairs_of_a_bucket(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = np.array(sorted({near(rng, rng.choice(base), rng.randint(0, 5)) for _ in range(400)}), np.uint64)
    bucket = np.array([int(f) % 3 for f in fps])
    order = np.lexsort((simhash.gray_rank(fps), bucket))
    fps, bucket = fps[order], bucket[order]
    got = {(int(i), int(j)) for a, b in simhash.linked_pairs(bucket, fps, chunk=500) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bucket[i] == bucket[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert got == want


def test_keep_one(spark):
    docs = documents(spark, *TEXTS)
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(comp.values())
    twice = documents(spark, "a b c", "a b c", "x y z", "x y z", None, ids=[7, 7, None, None, 9])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(twice).collect() if r["text"]) == [(0, "x y z"), (7, "a b c")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_repeats_null_ids_and_empty(spark):
    docs = documents(spark, "a b c", "a b c", None, ids=[None, 4, None])
    assert rows(simhash.near_duplicates(docs), "doc_id", "component_id") == sorted([(None, 4), (4, 4), (None, None)], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_reads_a_folder(spark, tmp_path):
    assert simhash.op9_simhash_near_dedup(spark, as_folder(tmp_path, documents=documents(spark, "a b c"))).count() == 1

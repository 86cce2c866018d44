import random

import corpus_pipeline
import numpy as np
import pytest

from loomsearch.llm import resemblance

from .helpers import documents


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def like(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if like(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def edited(rng, words, places):
    words = list(words)
    for k in rng.sample(range(len(words)), places):
        words[k] = f"new{rng.getrandbits(40)}"
    return words


def crowd(rng, copies=60):
    """Texts, and copies of them with 0 to 12 of 200 words exchanged, also copies of copies."""
    texts = [[f"w{rng.getrandbits(16)}" for _ in range(200)] for _ in range(4)]
    for _ in range(copies):
        texts.append(edited(rng, rng.choice(texts), rng.randint(0, 12)))
    return [" ".join(t) for t in texts]


def test_stage_keeps_one_of_each_group_of_resembling_texts(spark):
    texts = [*crowd(random.Random(3)), "", None, "a b", "A B", "a b c d e f", "a b c d e g"]
    want = set(brute([shingles(t or "") for t in texts]))
    docs = documents(spark, *texts)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_components_inside_a_crowd(seed):
    sets = [shingles(t) for t in crowd(random.Random(seed), 100)]
    assert list(resemblance.forest([resemblance.shingle_set(t) for t in crowd(random.Random(seed), 100)])) == brute(sets)


def test_pairs_at_the_least_similarity_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 100, np.uint64)
        assert (resemblance.band_keys(x[:90]) == resemblance.band_keys(x[10:])).any()


@pytest.mark.parametrize(("a", "b", "both"), [(100, 100, 0), (90, 90, 80), (100, 80, 80), (8, 10, 8), (450, 450, 400), (3000, 3000, 2990)])
def test_fingerprints_differ_by_the_angle_of_the_sets(a, b, both):
    rng = np.random.default_rng(2)
    bits, far = 64 * resemblance.WORDS, []
    for _ in range(40 if a < 1000 else 4):
        x = rng.integers(0, 1 << 63, a + b - both, np.uint64) * np.uint64(2)
        u, v = resemblance.fingerprint(x[:a]), resemblance.fingerprint(x[a - both :])
        far.append(int(np.bitwise_count(u ^ v).sum()))
        if 5 * both >= 4 * len(x):
            assert np.bitwise_count(u[0] ^ v[0]) <= resemblance.RADIUS and resemblance.apart(u[:3], v[:3]) <= resemblance.REACH
    assert abs(np.mean(far) / bits - np.arccos(both / np.sqrt(a * b)) / np.pi) < 0.02


@pytest.mark.parametrize(("group", "others"), [(0, 200), (700, 300), (40, 500)])
def test_candidates_of_buckets_against_all_pairs(group, others):
    rng = np.random.default_rng(group)
    words = rng.integers(0, 1 << 63, (others, 3), np.uint64)
    base = rng.integers(0, 1 << 63, 3, np.uint64)
    for _ in range(group):  # near the base, in the first word too, and some of them further out
        flips = rng.random(192) < rng.choice([0.05, 0.15, 0.25])
        words = np.vstack([words, base ^ np.packbits(flips).view(np.uint64)])
    words = np.vstack([words, words[:20] ^ np.uint64(0x0101010101), words[:20]])
    key = np.r_[np.zeros(len(words) - 60, np.int32), np.ones(20, np.int32), np.zeros(40, np.int32)]

    def classes(links):
        root = np.arange(len(same))
        resemblance.merge(root, *links)
        return root

    same, where = np.unique(words[:, 0], return_inverse=True)
    d = np.bitwise_count(words[:, None] ^ words[None])
    meet = (key[:, None] == key) & (d.sum(axis=2) <= resemblance.REACH)
    loose, strict = classes([where[k] for k in np.nonzero(meet)]), classes([where[k] for k in np.nonzero(meet & (d[:, :, 0] <= resemblance.RADIUS))])
    u, v = resemblance.meetings(key, words)
    got = classes([np.searchsorted(same, u), np.searchsorted(same, v)])
    assert len(u) == len(same) - len(np.unique(got))  # a forest
    assert (got[strict] == got).all() and (loose[got] == loose).all()


def test_candidates_come_from_fingerprints(spark):
    rng = random.Random(8)
    texts = crowd(rng)
    rows = resemblance.sketches(documents(spark, *texts))
    words = {r["doc_id"]: r["words"] for r in rows.collect()}
    assert all(words[k] == resemblance.fingerprint(resemblance.shingle_set(t)).view(np.int64).tolist() for k, t in enumerate(texts))
    distinct = rows.select("fp", "words").dropDuplicates(["fp"])
    links = resemblance.candidates(distinct, distinct.count()).collect()
    place = {w: k for k, w in enumerate(sorted({w[0] for w in words.values()}))}
    root = np.arange(len(place))
    resemblance.merge(root, *(np.array([place[r[c]] for r in links]) for c in ("u", "v")))
    sets = [shingles(t) for t in texts]
    at = [root[place[words[k][0]]] for k in range(len(texts))]
    assert all(at[i] == at[j] for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j]))
    assert all(sets[i] & sets[j] for i in range(len(sets)) for j in range(i) if at[i] == at[j])

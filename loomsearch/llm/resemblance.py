"""Near-duplicates by wide SimHash fingerprints of word shingles: the pipeline's stage.

Two texts are linked when their sets of five-word shingles have a Jaccard
similarity of at least 0.8; the components of these links are the groups.

A text's fingerprint has ``WORDS`` words of 64 bits.  Each bit is the sign of a
sum over the shingles, whose weights are odd numbers from -255 to 255 taken
from their hashes, so that it differs between two texts with the probability
angle / pi of their sets: at most acos(8 / 9) / pi = 0.1515 at a similarity of
0.8.  Each word is cut into four blocks of 16 bits, and texts that agree on a
block meet in its bucket.  There the Gray-order index of ``simhash`` finds the
pairs that differ in at most ``RADIUS`` bits of the first word, and of these
the ones within ``REACH`` bits of the first three words are candidates.  Of
the pairs at 0.8, 3.1e-7 meet in none of the 200 buckets, and 0.8e-7 are
beyond a radius; fewer above.

Candidates, directly or over others, come together once as a crowd, and there
their sets are compared exactly, so that no pair below 0.8 is linked.

Inside such a crowd a search over the links starts from a pivot.  A member is
compared with those not yet reached only where the triangle inequality of the
Jaccard distance leaves a link possible, so that a crowd of close copies takes
about one comparison for each.

Defined results: texts of one to five words have one shingle; null and empty
texts have none and are alike; a very long text is sketched and compared whole;
upper and lower case of A-Z are alike; of repeated rows one stays, as of any
group the one with the smallest doc_id, nulls last; no rows give no rows; other
columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, shuffle_width, small_side, whole_text
from .components import components, merge
from .simhash import gray_rank, keep_least, linked_pairs, shingle_hashes

SIZE, WORDS, BLOCKS = 5, 50, 200
#: Most differing bits of a candidate in the first word, and in the first three.
RADIUS, REACH = 27, 58
#: Least similarity of a link, as a fraction.
NUM, DEN = 4, 5
#: Hashes of a text that are summed at a time; at most 257, for 16 bits to hold the sum of bytes.
CHUNK = 128
#: Rows of a bucket that are compared without a look for a dense group, looks that may find none, rows that a task is planned for, and that it works on at a time.
SPARSE_ROWS, LOOKS, TASK_ROWS, PART_ROWS = 256, 8, 250_000, 1 << 15

_rng = np.random.default_rng(5)
_TURN, _ODD = _rng.integers(0, 1 << 63, (2, WORDS * 8), np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.uint64(0x00FF00FF00FF00FF)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text or "", size))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The words of the fingerprint of a set of shingles; each shingle gives a byte to the sum of each bit."""
    sums = np.zeros((2, WORDS * 32), np.int64)
    for k in range(0, len(hashes), CHUNK):
        x = hashes[k : k + CHUNK, None] ^ _TURN
        x *= _ODD
        x ^= x >> np.uint64(32)
        sums[0] += (x & _BYTES).sum(axis=0).view(np.uint16)
        sums[1] += ((x >> np.uint64(8)) & _BYTES).sum(axis=0).view(np.uint16)
    return np.packbits(2 * sums.ravel() > 255 * len(hashes)).view(np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The value of each block of the fingerprint; none for a text without shingles."""
    return fingerprint(hashes).view(np.uint16) if len(hashes) else np.empty(0, np.uint16)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, words) of each row; ``fp`` stands for the set of shingles, ``words`` are its fingerprint, empty without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            fp = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets), np.uint64, len(sets)).view(np.int64)
            words = [fingerprint(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp), pa.array(words, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fp", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long, words array<long>")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the first three words differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def thinned(words: np.ndarray, rows: np.ndarray, chunk: int = 1 << 17) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Links of a bucket's dense groups, and the rows whose links with each other are still to be found.

    What is near a pivot is one class.  A member of it is compared with a row
    outside only where the triangle inequality leaves a link possible, and a
    row outside needs one link to the class.
    """
    out, misses = [], 0
    while len(rows) > SPARSE_ROWS and misses < LOOKS:
        pivot = rows[misses * len(rows) // LOOKS]
        far = apart(words[rows], words[pivot])
        near = far <= REACH
        out.append((rows[near], np.full(near.sum(), pivot)))
        if 16 * near.sum() < len(rows):
            rows, misses = rows[rows != pivot], misses + 1
            continue
        by = np.argsort(far[near], kind="stable")
        group, rest = rows[near][by], rows[~near]
        least = np.searchsorted(far[near][by], far[~near] - REACH)
        work = np.cumsum(len(group) - least)
        a = 0
        while a < len(rest):
            b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + chunk, "right")))
            n = len(group) - least[a:b]
            i = np.repeat(np.arange(a, b), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(least[a:b], n)
            hit = np.unique(i[apart(words[rest[i]], words[group[j]]) <= REACH])
            out.append((rest[hit], np.full(len(hit), pivot)))
            a = b
        rows = rest
    return out, rows


def meetings(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v), by first words, of the candidates that the buckets ``key`` show."""
    order = np.lexsort((gray_rank(words[:, 0]), key))
    key, words = key[order], words[order]
    again = np.r_[False, (key[1:] == key[:-1]) & (words[1:] == words[:-1]).all(axis=1)][: len(key)]
    key, words = key[~again], words[~again]
    opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    sizes = np.diff(np.r_[opens, len(key)])
    left, found = np.repeat(sizes > 1, sizes), []
    for k in np.flatnonzero(sizes > SPARSE_ROWS):
        rows = np.arange(opens[k], opens[k] + sizes[k])
        links, rest = thinned(words, rows)
        found += [(words[i, 0], words[j, 0]) for i, j in links]
        left[rows] = False
        left[rest] = True
    key, words = key[left], words[left]
    for i, j in linked_pairs(key, words[:, 0].copy(), RADIUS, 1 << 17):
        near = apart(words[i], words[j]) <= REACH
        found.append(spanning(words[i[near], 0], words[j[near], 0]))
    none = np.empty(0, np.uint64)
    return spanning(*(np.concatenate([none, *(x[k] for x in found)]) for k in (0, 1)))


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links."""
    same, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(same))
    merge(root, where[: len(u)], where[len(u) :])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return same[moved], same[root[moved]]


def candidates(texts: DataFrame, n: int) -> DataFrame:
    """Links (u, v), by the first words of fingerprints, that join the candidates among ``n`` texts (fp, words).

    A large group meets in many tasks, and each links it to a member of its own.
    All links of one ``u`` then come together once more and are joined to the
    least node they reach, mostly the same in all tasks, so that about one link
    for each member is left, not one for each member and task.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS)
            for k in range(0, len(words), 512):
                part = words[k : k + 512]
                key = np.arange(BLOCKS, dtype=np.int32) << 16 | part.view(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *[pa.array(np.repeat(part[:, c], BLOCKS)) for c in range(3)]], names=["key", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        key, words = np.concatenate([b.column(0).to_numpy() for b in got]), np.empty((sum(b.num_rows for b in got), 3), np.int64)
        for c in range(3):
            np.concatenate([b.column(c + 1).to_numpy() for b in got], out=words[:, c])
        del got
        order = np.argsort(key)
        ends = np.append(np.flatnonzero(np.diff(key[order])) + 1, len(key))  # of the buckets
        found, a = [], 0
        while a < len(key):
            b = ends[max(np.searchsorted(ends, a + PART_ROWS, "right") - 1, np.searchsorted(ends, a, "right"))]
            found.append(meetings(key[order[a:b]], words[order[a:b]].view(np.uint64)))
            a = b
        u, v = spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], names=["u", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            u, v = spanning(*(np.concatenate([b.column(k).to_numpy() for b in got]).view(np.uint64) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], names=["u", "v"])

    dealt = texts.select("words").mapInArrow(deal, "key int, a long, b long, c long")
    spark = texts.sparkSession
    met = dealt.repartition(shuffle_width(spark, n * BLOCKS, TASK_ROWS), "key").mapInArrow(run, "u long, v long")
    return met.repartition(shuffle_width(spark, n, TASK_ROWS), "u").mapInArrow(join, "u long, v long").distinct()


def crowds(texts: DataFrame) -> DataFrame:
    """(node, root): the texts (fp, words) that are candidates with others, and the root of their crowd."""
    texts = texts.where(F.size("words") > 0)
    found = materialize(components(candidates(texts, texts.count())), "candidates")
    first = texts.select("fp", F.get("words", F.lit(0)).alias("node"))
    rooted = materialize(first.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("root")), "rooted")
    shared = materialize(rooted.groupBy("root").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least != most").select("root"), "shared-roots")
    return rooted.join(small_side(shared, shared.count()), "root").select(F.col("fp").alias("node"), "root")


def forest(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first of its component, by links of Jaccard similarity NUM / DEN or more."""
    sizes = np.array([len(s) for s in sets])
    vocabulary, columns = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
    rows, seen = np.split(columns, np.cumsum(sizes)[:-1]), np.zeros(len(vocabulary), bool)
    reach = 1 - NUM / DEN + 1e-9

    def shared(f: int, others: np.ndarray) -> np.ndarray:
        seen[rows[f]] = True
        n = np.fromiter((np.count_nonzero(seen[rows[b]]) for b in others), np.int64, len(others))
        seen[rows[f]] = False
        return n

    root, left = np.arange(len(sets)), np.arange(len(sets))
    while len(left):
        pivot, left = left[0], left[1:]
        common = shared(pivot, left)
        away = np.zeros(len(sets))
        away[left] = 1 - common / (sizes[left] + sizes[pivot] - common)
        linked = DEN * common >= NUM * (sizes[left] + sizes[pivot] - common)
        front, left = list(left[linked]), left[~linked]
        while front and len(left):
            f = front.pop()
            root[f] = pivot
            near = (np.abs(away[left] - away[f]) <= reach) & (DEN * np.minimum(sizes[left], sizes[f]) >= NUM * np.maximum(sizes[left], sizes[f]))
            some = left[near]
            common = shared(f, some)
            linked = some[DEN * common >= NUM * (sizes[some] + sizes[f] - common)]
            root[linked] = pivot
            front += list(linked)
            left = left[~np.isin(left, linked)]
        root[front] = pivot
    return root


def linked(docs: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, root) of the texts that are linked to an earlier one, by exact similarity."""
    found = materialize(crowds(texts), "crowd-members")
    one = prints.groupBy("fp").agg(F.min("text_hash").alias("text_hash"))
    members = materialize(one.join(found, one["fp"] == found["node"]).select("text_hash", "fp", "root"), "crowd-texts")
    whole = docs.select(F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    whole = whole.join(small_side(members, members.count()), "text_hash").groupBy("fp", "root").agg(F.first("text").alias("text"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("fp")
        fp, first = part["fp"].to_numpy(), forest([shingle_set(t) for t in part["text"]])
        moved = first != np.arange(len(first))
        return pd.DataFrame({"fp": fp[moved], "root": fp[first[moved]]})

    return whole.groupBy("root").applyInPandas(run, "fp long, root long")


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root): the set of each row and the root of its component."""
    rows = materialize(sketches(docs), "sketches")
    prints = rows.select("doc_id", "text_hash", "fp")
    texts = materialize(rows.select("fp", "words").dropDuplicates(["fp"]), "distinct-sketches")
    found = materialize(linked(docs, prints, texts), "resembling")
    return prints.join(small_side(found, found.count()), "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component, one for each; of repeated rows, one."""
    with Scratch(docs.sparkSession) as scratch:
        return keep_least(docs, cluster(docs), scratch)

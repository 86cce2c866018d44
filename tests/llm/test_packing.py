import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomsearch.llm import packing

from .helpers import SMALL, documents, needs_tables

PATH = packing.vocabulary_path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, world!", "it's we'll DON'T x's", "naïve café İstanbul ΣΑΣ straße", "tabs\tand\nlines\r\n\n  more", "\U0001f600\U0001f468‍\U0001f469 emoji", "中文字符 and 日本語", "é combining", "1234567 3.14 1,000", "<|endoftext|> <|x",
    " nbsp em​zw", "word " * 9000, "a" * 3000, "\x00\x01\x7f\x85", "Ω Å ﬁ ǅ", "привет мир", "100% #tag @user $5 http://a.b/c?d=e&f",
]


def test_tokens_are_those_of_the_file():
    exact, own = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    texts = [t or "" for t in TEXTS]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids, t[:60]


@needs_tables
def test_tokens_of_all_documents(spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    exact, own = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    for part in packing.slices(texts, 50_000):
        for t, ids in zip(part, own.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids


def valid(rows, texts, capacity=packing.CAPACITY):
    exact, by_doc, bins = Tokenizer.from_file(PATH), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for k, t in texts.items():
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        pieces = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), capacity)) and [r["piece"] for r in pieces] == list(range(len(pieces)))
        for r in pieces:
            part = ids[r["start"] : r["start"] + capacity]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(bins), total


def test_edges(spark):
    n, total = valid(packing.packed(documents(spark, *TEXTS), PATH).collect(), dict(enumerate(TEXTS)))
    assert n == -(-total // packing.CAPACITY)


def test_repeated_rows_null_ids_and_empty(spark):
    docs = documents(spark, "one two", "one two", None, ids=[None, None, 3])
    assert packing.packed(docs, PATH).count() == 3 and packing.packed(docs.limit(0), PATH).count() == 0


@needs_tables
def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    n, total = valid(packing.op6_best_fit_packing(spark, SMALL).collect(), texts)
    assert n <= -(-total // packing.CAPACITY) + 1


def fewest(sizes, capacity):
    """The optimum by trying everything."""
    best = [len(sizes)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                bins[i] += sizes[k]
                put(k + 1, bins)
                bins[i] -= sizes[k]
        put(k + 1, [*bins, sizes[k]])

    sizes = sorted(sizes, reverse=True)
    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(20))
def test_near_the_optimum(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 60) for _ in range(11)]
    where, offset = packing.pack(sizes, 100)
    fill = np.bincount(where, sizes)
    assert fill.max() <= 100 and len(fill) <= fewest(sizes, 100) + 1
    assert all(offset[k] + sizes[k] <= 100 for k in range(len(sizes)))


def test_search_empties_bins_that_best_fit_leaves():
    rng = random.Random(2)
    emptied = 0
    for _ in range(20):
        sizes = np.array([rng.randint(5, 60) for _ in range(60)])
        start = packing.best_fit(sizes, 100)
        out = packing.local_search(sizes, start, 100)
        before, after = np.bincount(start, sizes), np.bincount(out, sizes)
        assert after.max() <= 100 and (after**2).sum() >= (before**2).sum()
        emptied += len(before) - np.count_nonzero(after)
    assert emptied > 10


def test_no_exchange_is_left():
    """What the tables say of exchanges is what trying all of them says."""
    rng = random.Random(3)
    for _ in range(40):
        sizes = np.array([rng.randint(1, 40) for _ in range(14)])
        where = packing.best_fit(sizes, 60)
        fill = np.bincount(where, sizes).astype(np.int64)
        pieces = packing.Underfull.of(sizes, where, fill, 60)
        for a in pieces.bins.tolist():
            best = 0
            mine = [k for k in range(14) if where[k] == a]
            for b in pieces.bins.tolist():
                other = [k for k in range(14) if where[k] == b]
                for m, n in ((1, 0), (1, 1), (2, 1), (1, 2)):
                    for xs in itertools.combinations(mine, m) if a != b else ():
                        for ys in itertools.combinations(other, n):
                            d = int(sizes[list(xs)].sum() - sizes[list(ys)].sum())
                            if 0 < d <= 60 - fill[b]:
                                best = max(best, d * (d + fill[b] - fill[a]))
            swap = packing.exchange(a, pieces, sizes, where, 60)
            gain = 0
            if swap:
                xs, b, ys = swap
                assert all(where[k] == a for k in xs) and all(where[k] == b for k in ys) and len(set(xs)) == len(xs)
                d = int(sizes[list(xs)].sum() - sizes[list(ys)].sum())
                assert 0 < d <= 60 - fill[b]
                gain = d * (d + fill[b] - fill[a])
            assert gain == best


def test_groups_waste_no_sequence_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    rng = random.Random(5)
    texts = ["word " * rng.randint(0, 60) for _ in range(300)]
    n, total = valid(packing.packed(documents(spark, *texts), PATH, 128).collect(), dict(enumerate(texts)), 128)
    assert n <= -(-total // 128) + 1


@needs_tables
def test_the_query_leaves_few_rooms(spark):
    """The query's own path: exchanges empty sequences that best fit opened, over more than one group."""
    folder = SMALL.replace("0.001", "0.01")
    got = packing.op6_best_fit_packing(spark, folder).collect()
    total = sum(r["length"] for r in got)
    sizes = np.array([r["length"] for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"]))])
    assert len({r["sequence_id"] for r in got}) <= -(-total // packing.CAPACITY) + 1 < packing.best_fit(sizes, packing.CAPACITY).max() + 1


def test_many_equal_sizes():
    where, _ = packing.pack([2048] * 2001 + [1] * 3, 4096)
    assert where.max() + 1 == 1001

import re
from collections import Counter

import numpy as np

from loomsearch.llm import quality

from .helpers import SMALL, documents, needs_tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


TEXTS = [
    None, "", " \n ", "one", "a b c", "a b c a b c", "a a a a", "a a a a a", "x\ny\nx\nx\r\n\n\n", "# * $ % & | < > é \U0001f600", "w " * 60, " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)),
    "a b c", "lead " + "p q r s " * 20 + " ".join(f"u{i}" for i in range(200)), " ".join(f"v{i}" for i in range(30000)), "same line\n" * 400 + " ".join(f"z{i}" for i in range(900)), "\x00 \x1f \x85",
]


def same(rows):
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute(r["text"]), (r["text"] or "")[:100]
        assert not (r["base_failed"] and r["kept"])


def test_edges_against_brute_force(spark):
    docs = documents(spark, *TEXTS)
    same(docs.select("doc_id", "text").join(quality.judge(docs, []), "doc_id").collect())


@needs_tables
def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    same(docs.select("doc_id", "text").join(quality.op4_quality_rules(spark, SMALL), "doc_id").collect())


def test_list_is_learned_and_applied():
    rng = np.random.default_rng(0)
    x = rng.random((900, len(quality.FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 4] < 0.2) & (x[:, 1] > 0.5))
    rules = quality.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= r.covers(x)
    assert rules and (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * (~bad).sum()


def test_rules_as_columns_agree_with_numpy(spark):
    docs = documents(spark, *TEXTS)
    rules = [quality.Rule((("symbol_share", True, 0.05),)), quality.Rule((("distinct_share", False, 0.5), ("n_words", True, 100.0)))]
    stats = quality.statistics(docs).select("doc_id", "__quality").collect()
    x = np.array([[r["__quality"][f"f_{n}"] for n in quality.FEATURES] for r in stats])
    want = {r["doc_id"]: not (r["__quality"]["n_words"] < 50 or 100 * r["__quality"]["n_repeat_words"] > 50 * r["__quality"]["n_words"] or rules[0].covers(x)[k] or rules[1].covers(x)[k]) for k, r in enumerate(stats)}
    assert {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).collect()} == want
    kept = quality.keep_good(docs, rules)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, v in want.items() if v)


def test_nothing_to_learn(spark):
    docs = documents(spark, *TEXTS)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) == [] == quality.fit(docs.limit(0), labels.limit(0))
    assert quality.judge(docs.limit(0), []).count() == 0 == quality.keep_good(docs.limit(0), []).count()
    twice = documents(spark, "w", "w", ids=[None, None])
    assert quality.judge(twice, []).count() == 2


@needs_tables
def test_few_good_documents_are_rejected(spark):
    folder = SMALL.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.op4_quality_rules(spark, folder).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    good, bad = n.get((1, True), 0) + n.get((1, False), 0), n.get((0, True), 0) + n.get((0, False), 0)
    assert n.get((1, False), 0) <= 0.05 * good and n.get((0, False), 0) >= 0.6 * bad

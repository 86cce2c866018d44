"""The pipeline and its stages against what the operators say of the same input."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from loomsearch.llm import langid, pii, quality
from loomsearch.llm.common import read

from .helpers import SMALL, as_folder, documents, needs_tables
from .test_packing import valid
from .test_resemblance import brute, shingles

DOCS = ("doc_id", "text", "lang", "source", "n_chars")


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_near_dedup", "pii_sanitised", "best_fit_packing"]


@needs_tables
def test_stages_one_by_one(spark, tmp_path):
    docs = read(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name: as_folder(tmp_path / name, documents=stages[name](spark, docs, SMALL))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    verdicts = quality.judge(docs, quality.fit(docs, read(spark, SMALL, "labels")))
    docs = read(spark, step("quality_rules"), "documents")
    assert ids(docs) == ids(verdicts.where("kept")) and sorted(docs.columns) == sorted(DOCS)

    said = langid.predictions(docs, langid.Model(langid.sample(docs)), ["doc_id"])
    want = ids(said.where((F.col("__lang") != "und") & (F.col("__rate") <= langid.MOST_PHRASES)))
    docs = read(spark, step("language_id"), "documents")
    assert ids(docs) == want and len(want) >= 0.9 * said.count()

    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {rows[k][0] for k in set(brute([shingles(t or "") for _, t in rows]))}  # the smallest doc_id of each group
    docs = read(spark, step("simhash_near_dedup"), "documents")
    assert ids(docs) == want and docs.count() == len(want)

    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    docs = read(spark, step("pii_sanitised"), "documents")
    after = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(after) == set(before)
    clean = ids(pii.scan(read(spark, str(tmp_path / "simhash_near_dedup"), "documents")).where("spans = ''"))
    assert all(after[k] == before[k] for k in clean) and len(clean) < len(before)
    assert pii.scan(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0

    packed = stages["best_fit_packing"](spark, docs, SMALL).collect()
    n, total = valid(packed, after)
    assert n <= -(-total // 4096) + 1
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(tuple(r) for r in whole.drop("sequence_id", "offset").collect()) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_repeated_rows_and_a_very_long_text(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choices(("ka", "lo", "mi", "ter", "son", "ed"), k=rng.randint(1, 4))) for _ in range(400)]
    text, long = " ".join(rng.choices(words, k=200)), " ".join(rng.choices(words, k=60_000))
    docs = documents(spark, text, text, long, None, ids=[4, 4, 5, None], lang=["en"] * 4)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = corpus_pipeline.run(spark, as_folder(tmp_path, documents=docs, labels=labels)).collect()
    assert {(r["doc_id"], r["piece"]) for r in got if r["doc_id"] == 4} == {(4, 0)} and sum(r["doc_id"] == 4 for r in got) == 1
    assert {r["doc_id"] for r in got} == {4, 5} and sum(r["doc_id"] == 5 for r in got) > 20


@pytest.mark.parametrize("rows", [0, 3])
def test_odd_tables(spark, tmp_path, rows):
    docs = documents(spark, None, "", "x y z").limit(rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = as_folder(tmp_path, documents=docs, labels=labels)
    assert corpus_pipeline.run(spark, folder).count() == 0
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name

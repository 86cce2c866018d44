"""License scans: base phrases, and an exact set-similarity join with notice templates.

A text block is a line, or a paragraph of several lines.  A block matches a
template when it holds at least ``THRESHOLD`` of the template's distinct
words.  Tokens are ordered by how many documents of the whole corpus have
them, rarest first.  For a needed overlap of o words, a block and a template
can only match if the first |block| - o + 1 and |template| - o + 1 tokens in
that order have one in common (prefix filter), the block has o tokens of the
vocabulary (length filter), and the tokens after the first common one suffice
(positional filter); pairs that pass are verified, so that none is missed.

The templates are constants of this module, so everything derived from them
(vocabulary, document frequencies, prefixes) has a fixed size.  Defined
results: a null or empty text has no words, null first_word and last_word,
empty labels and score 0; a very long text is scanned whole; words of equal
document frequency are ordered by themselves; repeated rows are each scanned; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, read, whole_text

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
THRESHOLD = 0.8
#: (label, notice).  Labels may repeat; a document gets the label of any notice that matches.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_words(notice: str) -> list[str]:
    return sorted({w for w in re.split(BREAK, notice.lower()) if w})


def vocabulary() -> list[str]:
    return sorted({w for _, notice in TEMPLATES for w in template_words(notice)})


def needed(size: int, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _words(lowered: Column) -> Column:
    return F.split(lowered, BREAK)


def token_order(docs: DataFrame, vocab: list[str] | None = None) -> list[str]:
    """The template vocabulary, rarest first, by document frequency over the whole corpus."""
    vocab = vocabulary() if vocab is None else vocab
    held = F.array_intersect(_list(vocab), _words(ascii_lower(whole_text())))
    counts = {r["w"]: r["n"] for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each vocabulary word at most
    return sorted(vocab, key=lambda w: (counts.get(w, 0), w))


def _starts(w: Column, phrase: str) -> Column:
    """Word places, from 0, where the words of ``phrase`` stand one after another."""
    parts = phrase.split()

    def here(x: Column, i: Column) -> Column:
        hit = x == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & (F.coalesce(F.get(w, i + k), F.lit("")) == part)
        return F.when(hit, i)

    return F.filter(F.transform(w, here), lambda i: i.isNotNull())


def _blocks(lowered: Column, order: list[str]) -> Column:
    """The vocabulary words of each block, rarest first."""
    paragraphs = F.filter(F.split(lowered, r"\n[\x20\x09\x0D]*\n"), lambda p: p.contains("\n"))
    blocks = F.concat(F.split(lowered, "\n"), paragraphs)
    return F.filter(F.transform(blocks, lambda b: F.array_intersect(_list(order), _words(b))), lambda b: F.size(b) > 0)


def _overlap(block: Column, tokens: list[str], need: int) -> Column:
    """Common words of a block and a template, or 0 where a filter shows that they are too few."""
    prefix, n = _list(tokens[: len(tokens) - need + 1]), len(tokens)
    common = F.array_intersect(F.slice(block, 1, F.greatest(F.size(block) - need + 1, F.lit(0))), prefix)
    first = F.get(common, F.lit(0))
    later = F.least(F.size(block) - F.array_position(block, first), F.lit(n) - F.array_position(_list(tokens), first))
    verified = F.size(F.array_intersect(block, _list(tokens)))
    return F.when((F.size(block) < need) | (F.size(common) == 0), 0).when(1 + later < need, 0).when(verified >= need, verified).otherwise(0)


def scan(docs: DataFrame, order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts, places, labels and score of every row of ``docs``."""
    rank = {w: i for i, w in enumerate(order)}
    templates = [(label, sorted(template_words(notice), key=rank.__getitem__)) for label, notice in TEMPLATES]
    rare = sorted({w for _, t in templates for w in t[: len(t) - needed(len(t), threshold) + 1]})
    spaced = F.trim(F.regexp_replace(F.col("__low"), BREAK, " "))
    padded = F.concat(F.lit(" "), F.col("__sp"), F.lit(" "))
    df = docs.select("doc_id", ascii_lower(whole_text()).alias("__low")).withColumn("__sp", spaced)
    n_words = F.when(F.col("__sp") == "", 0).otherwise(F.length("__sp") - F.length(F.replace(F.col("__sp"), F.lit(" "), F.lit(""))) + 1)
    df = df.withColumn("__w", F.split("__sp", " ")).withColumn("__n", n_words)
    none = F.array().cast("array<int>")
    places = [F.when(padded.contains(f" {p} "), _starts(F.col("__w"), p)).otherwise(none) for p in PHRASES]
    df = df.withColumn("__places", F.array(*places))
    blocks = F.when(F.arrays_overlap("__w", _list(rare)), _blocks(F.col("__low"), order)).otherwise(F.array().cast("array<array<string>>"))
    df = df.withColumn("__blocks", blocks)
    best = []
    for label, tokens in templates:
        need = needed(len(tokens), threshold)
        most = F.array_max(F.transform("__blocks", lambda b: _overlap(b, tokens, need)))
        best.append(F.struct(F.lit(label).alias("label"), (F.coalesce(most, F.lit(0)) / F.lit(float(len(tokens)))).alias("score")))
    df = df.withColumn("__found", F.when(F.size("__blocks") > 0, F.filter(F.array(*best), lambda m: m["score"] > 0)).otherwise(F.array().cast("array<struct<label:string,score:double>>")))
    base = F.filter(F.array(*[F.when(F.size(F.get("__places", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    starts = F.flatten("__places")
    score = F.greatest(F.when(F.size(starts) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("__found", lambda m: m["score"])), F.lit(0.0)))
    return df.select(
        "doc_id",
        F.col("__n").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("__found", lambda m: m["label"])))), ",").alias("labels"),
        F.round(score, 6).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, token_order(docs))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows by brute force: every template against every block."""
    sql_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = ", ".join(f"('{label}', {sql_list(t)}, {len(t)}, {needed(len(t), threshold)})" for label, t in ((label, template_words(n)) for label, n in TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
WITH lowered AS (
  SELECT row_number() OVER () AS rid, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
worded AS (
  SELECT rid, doc_id, low, list_filter(regexp_split_to_array(low, '{BREAK}'), lambda x: x <> '') AS w FROM lowered),
phrase(p, label, k) AS (VALUES {phrases}),
hits AS (
  SELECT rid, label, i FROM worded, phrase, LATERAL unnest(range(len(w))) AS u(i)
  WHERE contains(array_to_string(w, ' '), p) AND array_to_string(w[i + 1:i + k], ' ') = p),
base AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY rid),
blocks AS (
  SELECT rid, unnest(string_split(low, chr(10))) AS b FROM worded
  UNION ALL
  SELECT rid, b FROM (SELECT rid, unnest(regexp_split_to_array(low, '\\n[\\x20\\x09\\x0D]*\\n')) AS b FROM worded) WHERE contains(b, chr(10))),
template(label, tokens, size, need) AS (VALUES {rows}),
scored AS (
  SELECT rid, label, len(list_filter(tokens, lambda t: list_contains(bw, t))) AS common, size, need
  FROM (SELECT rid, regexp_split_to_array(b, '{BREAK}') AS bw FROM blocks), template),
method AS (
  SELECT rid, list(DISTINCT label) AS labels, max(common / size) AS score FROM scored WHERE common >= need GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ',') AS labels,
       round(greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(score, 0.0::DOUBLE)), 6) AS score
FROM worded LEFT JOIN base USING (rid) LEFT JOIN method USING (rid)"""

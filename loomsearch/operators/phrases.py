"""Runs of tokens and how often they occur: Arrow functions, since an expression makes an object for each run.

A text has about three phrases for each of its tokens, most of them once in the
whole corpus, so that neither a row for each nor an aggregate before the
exchange pays.  Here the phrases of a few megabytes of text are numbered and
counted as integers, and go to ``BUCKETS`` buckets by a hash of their tokens,
packed: one row for each bucket.  A bucket is counted by itself, so that memory
is that of one bucket, and a phrase that is everywhere is one entry of each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS

TEXTS = ("title", "description", "content")
LEAST, MOST = 2, 4
#: Buckets at every size, and bytes of text that are counted at once.
BUCKETS, CHUNK_BYTES = 4096, 4 << 20
PACKED = "bucket int, phrases binary, counts binary"

_GAP = 0
_BYTES = np.zeros(256, np.uint8)
_BYTES[[*range(48, 58), *range(97, 123)]] = [*range(48, 58), *range(97, 123)]
_BYTES[65:91] = np.arange(97, 123)
#: Letters beyond ASCII that are ASCII letters in lower case.
_LETTERS = (("İ".encode(), ord("i")), ("K".encode(), ord("k")))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after another, and where each starts and the last one ends."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8), at - at[0]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What ``functions.text.tokenize`` finds: for each token its number and its text's, and the numbered tokens."""
    data, at = _buffers(texts)
    low = _BYTES[data]
    for letter, becomes in _LETTERS:
        if letter[0] in data:
            found = np.flatnonzero(data[: len(data) - len(letter) + 1] == letter[0])
            for k, byte in enumerate(letter[1:], 1):
                found = found[data[found + k] == byte]
            keep = np.ones(len(data), bool)
            for k in range(1, len(letter)):
                keep[found + k] = False
            low[found] = becomes
            data, low, at = data[keep], low[keep], np.concatenate(([0], np.cumsum(keep)))[at]
    inside = low != _GAP
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(low))]  # tokens end where their text does
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    ends = np.concatenate(([0], np.cumsum(lengths)))
    words = _binary(ends, pa.py_buffer(low[inside])).dictionary_encode()
    known = words.dictionary
    fine = pc.and_(pc.greater_equal(pc.binary_length(known), 2), pc.invert(pc.is_in(known, pa.array([w.encode() for w in STOP_WORDS], known.type)))).to_numpy(zero_copy_only=False)
    ids = words.indices.to_numpy()
    kept = fine[ids] if len(ids) else np.zeros(0, bool)
    owner = np.searchsorted(at, starts[kept], "right") - 1
    return ids[kept].astype(np.int64), owner, known


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key's number, the distinct keys, how often each occurs; keys are not negative."""
    bits = len(keys).bit_length()
    if int(keys.max()) >> (62 - bits):
        order = np.argsort(keys)
        found = keys[order]
    else:  # the place goes into the key: sorting numbers is several times as fast as sorting by them
        found = np.sort(keys << bits | np.arange(len(keys)))
        order, found = found & ((1 << bits) - 1), found >> bits
    new = np.ones(len(keys), bool)
    new[1:] = found[1:] != found[:-1]
    at = np.flatnonzero(new)
    ids = np.empty(len(keys), np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, found[at], np.diff(at, append=len(keys))


def _binary(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), data])


def pack(texts: pa.Array, prefix: bytes = b"") -> pa.RecordBatch | None:
    """The distinct phrases of the texts that start with the prefix and their counts, a row for each bucket that has some."""
    ids, owner, known = tokens(texts)
    none = len(known)  # stands for no further token
    hashes = np.fromiter((crc32(w) for w in known.to_pylist()), np.uint64, none)
    bits = none.bit_length()
    runs, mixed, number, parts = [np.arange(none, dtype=np.int32)], hashes, ids, []
    for n in range(2, MOST + 1):
        here = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.empty(0, np.int64)
        if not len(here):
            break
        of, keys, counts = _counted(number[here] << bits | ids[here + n - 1])
        before, last = keys >> bits, (keys & ((1 << bits) - 1)).astype(np.int32)
        runs, mixed = [*(r[before] for r in runs), last], mixed[before] * _ODD + hashes[last]
        number = np.zeros(len(ids), np.int64)
        number[here] = of
        if n >= LEAST:
            bucket = ((mixed ^ mixed >> np.uint64(29)) * _ODD >> np.uint64(40)).astype(np.uint16) % BUCKETS
            parts.append((*runs, *[np.full(len(last), none, np.int32)] * (MOST - n), counts, bucket))
    if not parts:
        return None
    *runs, counts, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(bucket, kind="stable")
    *runs, counts, bucket = (x[order] for x in (*runs, counts, bucket))
    spaced = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(b"", known.type), known, pa.scalar(b" ", known.type)), pa.array([b""], known.type)])
    words = [known.take(pa.array(runs[0])), *(spaced.take(pa.array(r)) for r in runs[1:])]
    phrases = pc.binary_join_element_wise(*words, pa.scalar(b"\n", known.type), pa.scalar(b"", known.type))
    if prefix:
        hit = pc.starts_with(phrases, pattern=prefix)
        phrases, hit = pa.concat_arrays([phrases.filter(hit)]), hit.to_numpy(zero_copy_only=False)
        counts, bucket = counts[hit], bucket[hit]
        if not len(counts):
            return None
    start = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] ^ 1))
    cuts = np.append(start, len(counts))
    at = np.frombuffer(phrases.buffers()[1], np.int64)[: len(counts) + 1]
    packed = _binary(at[cuts], phrases.buffers()[2]), _binary(cuts * 8, pa.py_buffer(np.ascontiguousarray(counts, np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), *(x.cast(pa.binary()) for x in packed)], ["bucket", "phrases", "counts"])


def packed(docs: DataFrame, prefix: str = "") -> DataFrame:
    """(bucket, phrases, counts) of all documents, a chunk of texts at a time."""
    start = prefix.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            chunk = np.cumsum(size) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    out = pack(pa.concat_arrays([c.slice(a, b - a) for c in batch.columns]), start)
                    if out is not None:
                        yield out

    return docs.select(*TEXTS).mapInArrow(run, PACKED)


def _merged(bucket: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The distinct phrases of a bucket, each with its line end, and their counts."""
    text = np.frombuffer(b"".join(bucket["phrases"].to_pylist()), np.uint8)
    ends = np.concatenate(([0], np.flatnonzero(text == ord("\n")) + 1)).astype(np.int64)
    counts = np.frombuffer(b"".join(bucket["counts"].to_pylist()), np.int64)
    found = _binary(ends, pa.py_buffer(text)).dictionary_encode()
    total = np.zeros(len(found.dictionary), np.int64)
    np.add.at(total, found.indices.to_numpy(), counts)
    return found.dictionary, total


def phrase_stats(docs: DataFrame, prefix: str = "") -> DataFrame:
    """(phrase, freq) over the titles, descriptions and contents of all documents; others than those with the prefix are left out early."""

    def count(bucket: pa.Table) -> pa.Table:
        phrases, total = _merged(bucket)
        return pa.table({"phrase": pc.binary_slice(phrases, 0, -1).cast(pa.string()), "freq": total})

    return packed(docs, prefix).groupBy("bucket").applyInArrow(count, "phrase string, freq long")


def phrase_count(docs: DataFrame) -> DataFrame:
    """(phrases): how many different ones there are."""

    def count(bucket: pa.Table) -> pa.Table:
        return pa.table({"phrases": np.array([len(_merged(bucket)[0])], np.int64)})

    return packed(docs).groupBy("bucket").applyInArrow(count, "phrases long").agg(F.coalesce(F.sum("phrases"), F.lit(0)).cast("long").alias("phrases"))

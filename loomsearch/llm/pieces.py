"""SentencePiece encoding and decoding by one walk over a trie of marked words.

Words carry the mark U+2581 in place of the space before them.  The distinct
words of a batch are sorted, which is the depth-first order of their trie, and
the forward state of a common prefix is computed once: at each prefix, the
last piece of its segmentation.

The public model is of the BPE kind, whose segmentation is not the one of
largest total score; a Viterbi search over the scores gives other ids than the
library does.  The forward state is therefore the last piece that BPE puts at
the end of the prefix: the piece t such that t follows the last piece u of the
rest and merging the letters of u + t again gives u, t.  There is exactly one
such t for each prefix, so that the state can be shared just as the best score.
Runs of several marks and code points that the vocabulary lacks are merged
the plain way or written as bytes.

Defined results: a null or empty text has no ids and decodes to the empty
string; a very long text is encoded whole, in a batch of its own; pairs of equal
rank are merged from the left; repeated rows are encoded each; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, whole_text
from .packing import slices, vocabulary_path

MARK = "▁"
#: Words and pairs of pieces that are remembered, and code points whose words are sorted together.
CACHE_WORDS, CACHE_PAIRS, SLICE_CHARS = 300_000, 1_000_000, 1 << 22


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id; type 1 is an ordinary piece and 6 a byte."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.model_type != 2 or not model.normalizer_spec.add_dummy_prefix:
        raise ValueError("only BPE models with the identity normaliser and a leading mark are supported")
    return [(p.piece, p.score, p.type) for p in model.pieces]


class Pieces:
    """Encodes and decodes with the pieces of a model file."""

    def __init__(self, path: str) -> None:
        model = read_model(path)
        self.score = {p: s for p, s, kind in model if kind == 1}
        self.coded = {p: k.to_bytes(4, "little") for k, (p, _, kind) in enumerate(model) if kind == 1}
        self.byte = {int(p[3:5], 16): k.to_bytes(4, "little") for k, (p, _, kind) in enumerate(model) if kind == 6}
        self.letters = {p for p in self.score if len(p) == 1}
        letters = re.escape("".join(sorted(self.letters - {MARK})))
        self.plain, self.cut = re.compile(f"[{letters}]*").fullmatch, re.compile(f"([^{letters}])").split
        self.surface = [bytes([int(p[3:5], 16)]) if kind == 6 else p.encode() if kind == 1 else b"" for p, _, kind in model]
        self.before: dict[str, dict[str, bool] | None] = {}
        self.n_pairs = 0
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of ``text`` in the order of their scores, leftmost first among equals."""
        part, left, right = list(text), list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(both := part[a] + part[b])) is not None:
                heapq.heappush(heap, (-s, a, b, both))

        for k in range(len(text) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not part[a] or not part[b] or part[a] + part[b] != both or right[a] != b:
                continue
            part[a], part[b], right[a] = both, "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p]

    def _stands(self, t: str) -> dict[str, bool] | None:
        """What is known of pieces before ``t``; None if ``t`` is no piece that merging gives."""
        out = self.before[t] = {} if t in self.score and self.merged(t) == [t] else None
        return out

    def _follows(self, u: str, t: str) -> bool:
        if self.n_pairs >= CACHE_PAIRS:
            for known in self.before.values():
                if known:
                    known.clear()
            self.n_pairs = 0
        ok = self.before[t][u] = self.merged(u + t) == [u, t]
        self.n_pairs += 1
        return ok

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of sorted words made of known letters, sharing the states of common prefixes."""
        last: list[str] = [""]  # by prefix length, its last piece
        before, known = "", self.before
        for w in words:
            same = len(commonprefix((before, w)))
            del last[same + 1 :]
            for end in range(same + 1, len(w) + 1):
                for start in range(end - 1, -1, -1):  # some start has a piece, so that only endings of pieces are looked up
                    t = w[start:end]
                    ahead = known[t] if t in known else self._stands(t)
                    if ahead is None:
                        continue
                    u = last[start]
                    if not start or (ahead[u] if u in ahead else self._follows(u, t)):
                        last.append(t)
                        break
                else:
                    raise AssertionError(f"no segmentation of {w[:end]!r}")
            before, out, end = w, [], len(w)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield w, out[::-1]

    def _as_bytes(self, parts: list[str]) -> bytes:
        try:
            return b"".join([self.coded[p] for p in parts])
        except KeyError:
            return b"".join([self.coded[p] if p in self.coded else b"".join([self.byte[x] for x in p.encode("utf-8", "surrogatepass")]) for p in parts])

    def _learn(self, units: set[str]) -> None:
        """Fills ``known``, by units without their first mark; ``old`` keeps the generation before, so that frequent words stay.

        No piece holds a code point that the vocabulary lacks, so that a unit is
        cut there and its parts are merged on their own.
        """
        if len(self.known) > CACHE_WORDS:
            self.known, self.old, self.inner = {}, self.known, {}
        known, inner, old, fresh, cut = self.known, self.inner, self.old, set(), []
        for u in units.difference(known):
            if (ids := old.get(u)) is not None:
                known[u] = ids
            elif MARK in u:
                known[u] = self._as_bytes(self.merged(MARK + u))
            elif self.plain(u):
                fresh.add(MARK + u)
            else:
                first, *rest = self.cut(u)
                cut.append((u, first, rest))
                if first not in known:
                    fresh.add(MARK + first)
                for lacked, part in zip(rest[::2], rest[1::2], strict=True):
                    inner[lacked] = self._as_bytes([lacked])
                    if part and part not in inner:
                        fresh.add(part)
        for w, parts in self.walk(sorted(fresh)):
            ids = self._as_bytes(parts)
            if w[0] == MARK:
                known[w[1:]] = ids
            else:
                inner[w] = ids
        inner[""] = b""
        for u, first, rest in cut:
            known[u] = known[first] + b"".join([inner[x] for x in rest])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split, units = [], set()
        for t in texts:
            if not t:
                words = []
            elif MARK in t or "  " in t or t[0] == " ":  # several marks: they belong to the word after them
                words = [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", MARK + t.replace(" ", MARK))]
            else:
                words = t.split(" ")
            split.append(words)
            units.update(words)
        self._learn(units)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text.removeprefix(MARK).replace(MARK, " ")


@cache
def codec_of(path: str) -> Pieces:
    """One for each worker process: its tasks share the words and pairs that it has learned."""
    return Pieces(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of each row as little-endian unsigned 32-bit binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in batches:
            ids = [x for part in slices(b.column(1).to_pylist(), SLICE_CHARS) for x in codec.encode(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from the rows of ``encoded``; null ids give the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_chars of the decoded text, and whether it equals the text, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for b in batches:
            rows = []
            for part in slices(b.column(1).to_pylist(), SLICE_CHARS):
                for t, ids in zip(part, codec.encode(part), strict=True):
                    back = codec.decode(ids)
                    rows.append((len(ids) // 4, zlib.crc32(ids), len(back), back == t))
            n, crc, chars, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (n, crc, chars)], pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "n_chars", "same"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, n_chars long, same boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))

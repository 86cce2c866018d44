"""Best-fit packing of tokenised documents by swap-based local search.

Documents are tokenised, closed with ``END_ID`` and cut only where they are
longer than a sequence.  Pieces are dealt round-robin into groups of a fixed
mean size.  A group's pieces are put, as they come, into the fullest sequence
with room.  Then a local search empties sequences: the emptiest one that can
gives a piece, or one or two in exchange for one or two, to the other underfull
sequence where that increases the sum of squared fills most.  While the group
has more sequences than its tokens need, that goes on until no exchange between
any two of them does; after that, the emptiest gives what it can.  The pieces of
a group's emptiest sequence, and of those with a room of ``ROOM`` or more, are
packed again with those of other groups, round by round, until one group is
left, so that no group wastes a sequence of its own.

All partners of an exchange are looked at: in a table of the pieces sorted by
sequence and size, the piece that leaves least room behind is found by
bisection.

Defined results: a null or empty text is one piece that holds only the end id;
a very long text gives as many pieces as it needs; of equally good sequences or
exchanges the first in the order of doc_id and piece is taken; repeated rows
are packed each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, runs, shuffle_width, whole_text

CAPACITY, END_ID = 4096, 1
#: Pieces of a packing group, on average; words that a tokeniser keeps, and code points tokenised at a time.
GROUP_PIECES, CACHE_WORDS, SLICE_CHARS = 1000, 300_000, 1 << 20
#: Share of a sequence that is much room.
ROOM = 1 / 32


# --- tokens -----------------------------------------------------------------------------------------------------------


class WordIds(dict):
    """Ids of lower-case words as bytes; a word is tokenised when it is first asked for.

    ``old`` holds the words of the generation before, so that at most twice
    ``CACHE_WORDS`` are kept and frequent ones stay.
    """

    def __init__(self, tokenize, parts) -> None:
        self.tokenize, self.parts, self.old = tokenize, parts, {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.visible = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}  # how byte-level vocabularies spell bytes

    def __missing__(self, w: str) -> bytes:
        ids = self.old.get(w)
        if ids is None:
            if w.isalpha():
                ids = self.of_part(w)
            elif w[:-1].isalpha():  # a word and one mark or digit
                ids = self[w[:-1]] + self[w[-1]]
            else:
                parts = self.parts(w)
                ids = self.of_part(w) if len(parts) == 1 else b"".join([self[p] for p in parts])
        self[w] = ids
        return ids

    def of_part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.visible)
        ids = [t.id for t in self.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def age(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class WordTokens:
    """The ids of a word-level BPE file, remembering words; texts with unusual code points go to the tokeniser whole."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.unusual = re.compile(r"[^\t\n\r\x20-\x7e\u00a1-\u024f\u0370-\u0377\u037b-\u037d\u0384-\u0386\u0388-\u038a\u038e-\u03a1\u03a3-\u0482\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20ac]|<\|").search
        self.known = WordIds(self.exact.model.tokenize, parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        import unicodedata

        out, ids_of = [], self.known.__getitem__
        for t in texts:
            if self.unusual(t):
                out.append(np.asarray(self.exact.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            else:  # no match of the pattern holds white space, so that words between spaces can be done one by one
                out.append(b"".join(map(ids_of, unicodedata.normalize("NFC", t).replace("Σ", "σ").lower().split())))
        self.known.age()
        return out


@cache
def encoder_of(path: str) -> WordTokens:
    """One for each worker process, which its tasks share."""
    return WordTokens(path)


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive runs of whole texts of about ``chars`` code points."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def pieces(docs: DataFrame, path: str, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, grp) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        turn = TaskContext.get().partitionId()  # the same in every attempt, so that a repeated task deals alike
        for b in batches:
            texts, at, rows = b.column(1).to_pylist(), 0, ([], [], [], [], [], [])
            for part in slices(texts):
                for ids in encoder.encode(part):
                    ids += END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        for col, v in zip(rows, (at, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), turn % groups), strict=True):
                            col.append(v)
                        turn += 1
                    at += 1
            take, *rest = rows
            cols = [b.column(0).take(pa.array(take, pa.int64())), pa.array(rest[0], pa.int32()), *[pa.array(r, pa.int64()) for r in rest[1:4]], pa.array(rest[4], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "grp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, grp long")


# --- packing ----------------------------------------------------------------------------------------------------------


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size; they are taken as they come, each into the fullest bin with room."""
    where = np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = bins = 0  # bit r of have: some bin has room r
    for k, s in enumerate(sizes.tolist()):
        fits = have >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                have &= ~(1 << room)
        else:
            room, at = capacity, bins
            bins += 1
        where[k] = at
        room -= s
        if room:
            rooms[room].append(at)
            have |= 1 << room
    return where


@dataclass
class Underfull:
    """The pieces of the bins with room, sorted by bin and size, and these bins."""

    places: np.ndarray
    key: np.ndarray
    bins: np.ndarray
    fill: np.ndarray
    step: int

    @classmethod
    def of(cls, sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, capacity: int) -> Underfull:
        places = np.flatnonzero(fill[where] < capacity)
        key = where[places] * (2 * capacity) + sizes[places]
        order = np.argsort(key, kind="stable")
        return cls(places[order], key[order], np.flatnonzero((fill < capacity) & (fill > 0)), fill, 2 * capacity)

    def least(self, bins: np.ndarray, size: np.ndarray, first: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the smallest piece of each bin that has at least ``size``, from row ``first`` on, and whether there is one."""
        at = np.maximum(np.searchsorted(self.key, bins * self.step + size), first)
        row = np.minimum(at, len(self.key) - 1)
        return row, (at < len(self.key)) & (self.key[row] // self.step == bins)


def exchange(a: int, pieces: Underfull, sizes: np.ndarray, where: np.ndarray, capacity: int) -> tuple[tuple[int, ...], int, tuple[int, ...]] | None:
    """What bin ``a`` gives, to which bin, and what it gets for it, such that the squared fill grows most.

    One piece is moved or exchanged for one or two, or two are exchanged for
    one.  What the other bin gains is never negative: an exchange that makes it
    emptier is one of its own as the giver.
    """
    bins, fill = pieces.bins[pieces.bins != a], pieces.fill
    if not len(bins):
        return None
    room = capacity - fill[bins]
    mine = np.flatnonzero(where == a)
    given, first, times = np.unique(sizes[mine], return_index=True, return_counts=True)
    first = mine[first]
    i, j = np.triu_indices(len(given))
    i, j = i[keep := (i != j) | (times[i] > 1)], j[keep]
    sums, pair = np.unique(given[i] + given[j], return_index=True)
    i, j = i[pair], j[pair]
    best, gain = None, 0

    def worth(d: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.where(d > 0, d * (d + fill[to] - fill[a]), 0)

    moved = worth(np.where(given[:, None] <= room[None], given[:, None], 0), bins[None])
    at = int(moved.argmax())
    if moved.flat[at] > gain:
        gain, best = int(moved.flat[at]), ((int(first[at // len(bins)]),), int(bins[at % len(bins)]), ())

    both = np.r_[given, sums]
    row, found = pieces.least(bins[None], np.maximum(both[:, None] - room[None], 1))
    swapped = worth(np.where(found, both[:, None] - sizes[pieces.places[row]], 0), bins[None])
    at = int(swapped.argmax())
    if swapped.flat[at] > gain:
        x, y = divmod(at, len(bins))
        xs = (int(first[x]),) if x < len(given) else (int(first[i[x - len(given)]]), int(first[j[x - len(given)]]))
        if len(xs) == 2 and xs[0] == xs[1]:
            xs = tuple(mine[sizes[mine] == sizes[xs[0]]][:2].tolist())
        gain, best = int(swapped.flat[at]), (xs, int(bins[y]), (int(pieces.places[row[x, y]]),))

    owner, size = where[pieces.places], sizes[pieces.places]
    later = np.arange(1, len(owner) + 1)
    for s, k in zip(given.tolist(), first.tolist(), strict=True):
        row, found = pieces.least(owner, np.maximum(s - (capacity - fill[owner]) - size, 1), later)
        swapped = worth(np.where(found & (owner != a), s - size - size[row], 0), owner)
        at = int(swapped.argmax())
        if swapped[at] > gain:
            gain, best = int(swapped[at]), ((k,), int(owner[at]), (int(pieces.places[at]), int(pieces.places[row[at]])))
    return best


def local_search(sizes: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """The bins after exchanges that each increase the sum of squared fills.

    While there are more bins than the sizes need, it ends only when no two
    bins have such an exchange; then, when the emptiest bin has none.
    """
    where, fewest = where.copy(), -(-int(sizes.sum()) // capacity)
    fill = np.bincount(where, sizes, int(where.max(initial=-1)) + 1).astype(np.int64)
    while True:
        pieces = Underfull.of(sizes, where, fill, capacity)
        givers = pieces.bins[np.argsort(fill[pieces.bins], kind="stable")]
        for a in givers[: None if np.count_nonzero(fill) > fewest else 1].tolist():
            if swap := exchange(a, pieces, sizes, where, capacity):
                break
        else:
            return where
        xs, b, ys = swap
        where[list(xs)], where[list(ys)] = b, a
        gained = int(sizes[list(xs)].sum() - sizes[list(ys)].sum())
        fill[a] -= gained
        fill[b] += gained


def pack(sizes: list[int] | np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; the bins are numbered from 0, by decreasing fill."""
    sizes = np.asarray(sizes, np.int64)
    where = local_search(sizes, best_fit(sizes, capacity), capacity)
    fill = np.bincount(where, sizes)
    rank = np.empty(len(fill), np.int64)
    rank[np.argsort(-fill, kind="stable")] = np.arange(len(fill))
    where = rank[where]
    order = np.argsort(where, kind="stable")
    ends = np.cumsum(sizes[order])
    opens = np.r_[0, np.cumsum(np.bincount(where, sizes))].astype(np.int64)
    offset = np.empty(len(sizes), np.int64)
    offset[order] = ends - sizes[order] - opens[where[order]]
    return where, offset


PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def packed_groups(rows: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """``rows`` (PIECE, grp) with sequence_id, offset, and whether its sequence is to be packed again."""
    spark = rows.sparkSession
    width = min(groups, shuffle_width(spark, groups * GROUP_PIECES, 200 * GROUP_PIECES))
    rows = rows.repartitionById(width, (F.col("grp") * width / groups).cast("int")).sortWithinPartitions("grp", "doc_id", "piece", "ids_crc32", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "grp"):
            where, offset = pack(group.column("length").to_numpy(), capacity)
            sequence = (turn << 48) + (group.column("grp").to_numpy() << 14) + where  # a group has no more bins than pieces
            fill = np.bincount(where, group.column("length").to_numpy())
            again = (fill <= capacity - ROOM * capacity) | (np.arange(len(fill)) == len(fill) - 1)
            new = (pa.array(sequence), pa.array(offset), pa.array(again[where]))
            yield pa.RecordBatch.from_arrays([*[group.column(c) for c in (*PIECE, "grp")], *new], names=[*PIECE, "grp", "sequence_id", "offset", "again"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, grp long, sequence_id long, offset long, again boolean"
    return rows.mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    groups, turn, out = -(-max(docs.count(), 1) // GROUP_PIECES), 0, None
    rows = pieces(docs, path, groups, capacity)
    while True:
        done = packed_groups(rows, groups, turn, capacity)
        if groups > 1:
            done = materialize(done, "packed")
        final = (done if groups == 1 else done.where(~F.col("again"))).select(*PIECE, "sequence_id", "offset")
        out = final if out is None else out.unionByName(final)
        if groups == 1:
            return out
        rows = done.where("again")
        fewer = max(1, min(-(-rows.count() // GROUP_PIECES), groups // 2))
        rows = rows.select(*PIECE, F.floor(F.col("grp") * fewer / groups).alias("grp"))
        groups, turn = fewer, turn + 1


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))

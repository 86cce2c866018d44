"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is
parsed into the longest phrases that occur in the labelled text of a language;
the fewer phrases it takes, the closer the two.  Phrase counts are normalised
by the log of the labelled text's length, and the language with the fewest
wins.

The automaton is turned into one table: for a state and a letter, the next
state and how many phrases end.  All texts of a batch walk through the tables
of all languages side by side, letter by letter.  Long texts are cut into
stretches that start as if a phrase began there.  Each is then walked again
from the state in which the stretch before it ended, until both walks are in
the same state, from where on they are one; the phrases counted up to there
replace those of the first walk.  So the counts are those of the whole text,
wherever it was cut.

The labelled sample is bounded: the documents with a letter of each of
``SLOTS`` classes of ids that come first by the hash of their id, and
``CHARS`` letters of each language, of which each of its documents gives an
equal share, or all it has.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
and when nothing could be learned; a very long text is parsed whole; ties go to
the first language by name; repeated rows are each predicted; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, read

SLOTS, CHARS, STRETCH = 64, 40_000, 2048
#: Phrases per letter above which a text is like no learned language; text of a learned one has 0.1 to 0.35.
MOST_PHRASES = 0.5
UNKNOWN = "und"
LOW = np.uint32((1 << 29) - 1)  # the part of a table's entry that is a state
LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(text: str | None) -> str:
    """Lower-case words with one space between them; everything but letters is left out."""
    return " ".join(LETTERS.findall((text or "").lower()))


def suffix_automaton(text: str) -> tuple[list[dict[str, int]], list[int]]:
    """Transitions of the states of the automaton that knows all substrings of ``text``, and their suffix links."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go, link


class Model:
    """Parse tables of all languages over one alphabet; letter 0 stands for letters that no labelled text has."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(x for x, t in texts.items() if t)
        self.alphabet = sorted({c for x in self.langs for c in texts[x]})
        width = self.width = len(self.alphabet) + 1
        code = {c: k for k, c in enumerate(self.alphabet, 1)}
        tables, self.roots, base = [], [], 0
        self.norm = np.array([1 / np.log2(len(texts[x]) + 2) for x in self.langs])
        for x in self.langs:
            go, _ = suffix_automaton(texts[x])
            root = np.full(width, -1, np.int64)
            for c, s in go[0].items():
                root[code[c]] = s
            # a letter that cannot be added ends a phrase and starts the next; one that is unknown is a phrase itself
            table = np.tile(np.where(root >= 0, ((base + np.maximum(root, 0)) * width) | 1 << 40, (base * width) | 2 << 40), (len(go), 1))
            table[0] = np.where(root >= 0, (base + np.maximum(root, 0)) * width, (base * width) | 1 << 40)
            for s, edges in enumerate(go):
                for c, to in edges.items():
                    table[s, code[c]] = (base + to) * width
            tables.append(table)
            self.roots.append(base * width)
            base += len(go)
        limit = base * width
        flat = np.concatenate(tables).ravel() if tables else np.empty(0, np.int64)
        if limit >= 1 << 29:
            raise ValueError("the labelled texts are too long for 32-bit tables")
        self.table = ((flat & ((1 << 40) - 1)) | (flat >> 40 << 29)).astype(np.uint32)
        self.root = np.array(self.roots, np.uint32)[:, None]

    @cached_property
    def code(self) -> np.ndarray:
        """The letter of each code point; made where it is used, so that it is not sent."""
        out = np.zeros(0x110000, np.uint32)
        out[[ord(c) for c in self.alphabet]] = np.arange(1, self.width)
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (of letters) for each language."""
        out = np.zeros((len(texts), len(self.langs)))
        if not self.langs:
            return out
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        cuts = -(-(ends - starts) // STRETCH)
        owner = np.repeat(np.arange(len(texts)), cuts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = np.repeat(starts, cuts) + STRETCH * nth
        size = np.minimum(np.repeat(ends, cuts) - at, STRETCH)
        state, count = self.walk(codes, at, size, np.repeat(self.root, len(at), 1))
        self.stitch(codes, at, size, nth, state, count)
        last = np.r_[nth[1:] == 0, True] if len(nth) else np.empty(0, bool)
        count += (state != self.root) & last
        for m in range(len(self.langs)):
            out[:, m] = np.bincount(owner, count[m], len(texts))
        return out

    def walk(self, codes: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last states and the numbers of phrases that end, of stretches walked from ``state`` (a row for each language)."""
        order = np.argsort(-size, kind="stable")
        at, size, state = at[order], size[order], state[:, order]
        count = np.zeros(state.shape, np.int64)
        live = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")
        for k in range(size.max(initial=0)):
            n = live[k]
            to = self.table[state[:, :n] + codes[at[:n] + k]]
            count[:, :n] += to >> np.uint32(29)
            state[:, :n] = to & LOW
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[:, back], count[:, back]

    def stitch(self, codes: np.ndarray, at: np.ndarray, size: np.ndarray, nth: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """Corrects ``state`` and ``count`` of stretches walked from the root for the states in which those before them ended.

        A stretch whose walks do not meet ends in another state than thought;
        the stretch after it is then walked once more.
        """
        begun = np.repeat(self.root, len(at), 1)  # where the walk that ``count`` stands for began
        todo = [np.flatnonzero((nth > 0) & (np.r_[self.root[m], state[m, :-1]] != self.root[m])) for m in range(len(self.langs))] if len(at) else []
        while any(map(len, todo)):
            row = np.repeat(np.arange(len(todo)), [len(x) for x in todo])
            col = np.concatenate(todo)
            new, old = state[row, col - 1], begun[row, col]
            begun[row, col] = new
            k, changed = 0, []
            while len(row):
                over = k == size[col]
                if over.any():  # the walks end apart
                    state[row[over], col[over]] = new[over]
                    changed.append((row[over], col[over]))
                apart = ~over & (new != old)
                row, col, new, old = row[apart], col[apart], new[apart], old[apart]
                letter = codes[at[col] + k]
                new, old = self.table[new + letter], self.table[old + letter]
                np.add.at(count, (row, col), (new >> np.uint32(29)).astype(np.int64) - (old >> np.uint32(29)))
                new, old = new & LOW, old & LOW
                k += 1
            rows, cols = (np.concatenate(x) for x in zip(*changed, strict=True)) if changed else (row, col)
            after = (cols + 1 < len(at)) & (nth[np.minimum(cols + 1, len(at) - 1)] > 0)
            todo = [cols[after & (rows == m)] + 1 for m in range(len(self.langs))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (how much fewer phrases than the next language) and phrases per letter."""
        plain = [letters_of(t) for t in texts]
        worth = self.phrases(plain) / self.norm[None] if self.langs else np.zeros((len(texts), 0))
        lang, score, rate = [], [], []
        for t, row in zip(plain, worth, strict=True):
            if not t or not len(row):
                lang.append(UNKNOWN), score.append(0.0), rate.append(1.0)
                continue
            best = int(row.argmin())
            rest = np.delete(row, best)
            lang.append(self.langs[best])
            score.append(float(1 - row[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
            rate.append(float(row[best] * self.norm[best] / len(t)))
        return lang, score, rate


def held_out(doc_id: str = "doc_id"):
    """True where the id's checksum keeps the document out of the labelled sample; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shares(lengths: list[int], total: int) -> list[int]:
    """How much each gives of ``total`` if all give the same, or all they have."""
    out, left = [0] * len(lengths), total
    for done, k in enumerate(sorted(range(len(lengths)), key=lambda k: (lengths[k], k))):
        out[k] = min(lengths[k], left // (len(lengths) - done))
        left -= out[k]
    return out


def sample(docs: DataFrame) -> dict[str, str]:
    """Labelled letters by language, a bounded number of them."""
    mixed = F.xxhash64("doc_id")
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    picked = rows.groupBy("lang", F.pmod(mixed, F.lit(SLOTS)).alias("slot")).agg(F.min(mixed).alias("h"))
    # a text gives at most CHARS letters, which are looked for in the whole of it
    texts = rows.select("lang", mixed.alias("h"), "text").join(F.broadcast(picked.select("lang", "h")), ["lang", "h"])  # SLOTS rows for each language
    letters = F.substring(F.regexp_replace("text", r"[^\p{L}]+", " "), 1, CHARS)
    texts = texts.groupBy("lang", "h").agg(F.min(letters).alias("text"))
    by_lang: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"])):
        by_lang.setdefault(r["lang"], []).append(letters_of(r["text"]) + " ")
    return {x: "".join(t[:n] for t, n in zip(ts, shares([len(t) for t in ts], CHARS), strict=True)) for x, ts in by_lang.items()}


def predictions(docs: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """The columns ``carried`` of ``docs`` with __lang, __score and __rate (phrases per letter)."""
    from .packing import slices

    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by CHARS for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            lang, score, rate = [], [], []
            for part in slices([t or "" for t in b.column(b.num_columns - 1).to_pylist()], 1 << 22):
                for into, new in zip((lang, score, rate), m.predict(part), strict=True):
                    into += new
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[*carried, "__lang", "__score", "__rate"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(*[F.col(f"`{c}`") for c in carried], F.col("text").alias("__t")).mapInArrow(run, f"{schema}, __lang string, __score double, __rate double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = Model(sample(docs))
    return predictions(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_known(docs: DataFrame, most_phrases: float = MOST_PHRASES) -> DataFrame:
    """The rows of ``docs`` that read like some learned language: not ``und``, and at most ``most_phrases`` phrases per letter.

    Nothing is rejected for its length: a rate above the limit needs letters or
    letter pairs that no labelled text has.  Without labels all rows stay.
    """
    model = Model(sample(docs))
    if not model.langs:
        return docs
    known = (F.col("__lang") != UNKNOWN) & (F.col("__rate") <= most_phrases)
    return predictions(as_row(docs, "text"), model, ["__row"]).where(known).select("__row.*")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))

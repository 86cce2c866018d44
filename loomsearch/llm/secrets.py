"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over lower-case
byte trigrams: what must occur in any text that the expression matches.  A
block of texts gets an inverted index of those trigrams that some rule asks
for (a trigram of the block's bytes is looked up in a bit table, and hits give
sorted postings).  Postings are intersected and united as the query says, and
only the candidates are verified with the expression.  Rules from which no
trigram follows scan every text.

Defined results: a null text counts as empty, with no spans and the digest of
an empty list; a very long text is indexed and scanned whole, as a block of its
own; spans that start at one place stand in the order of the rules; repeated
rows are each scanned; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, whole_text
from .packing import slices


def either_case(word: str) -> str:
    """``word`` with its letters A-Z in either case; no other letter folds onto them."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    good: Callable[[re.Match[str]], bool] = lambda m: True


NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")
#: The first three are the base kinds, in their order.
RULES = (
    Rule("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),  # runs of [0-9a-f]+ with 24 or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


# --- queries ----------------------------------------------------------------------------------------------------------

#: A query is True (any text), a trigram, or ("and" | "or", queries).
MOST_STRINGS, MOST_LETTERS = 128, 8


def _all(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[bytes]) -> object:
    return _any([_all([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _letters(node: tuple) -> set[bytes] | None:
    """The lower-case letters that one item of a pattern can match, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower().encode()} if chr(arg).isascii() else {chr(arg).encode()}
    if op is C.IN:
        out: set[bytes] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                span = (x,)
            elif kind is C.RANGE and x[1] - x[0] < MOST_LETTERS:
                span = range(x[0], x[1] + 1)
            else:
                return None
            out |= {chr(c).lower().encode() if chr(c).isascii() else chr(c).encode() for c in span}
        return out if len(out) <= MOST_LETTERS else None
    return None


def _sequence(nodes: list) -> tuple[set[bytes] | None, object]:
    """(the strings that the nodes match, if few; else None, and what must hold of a text they match in)."""
    exact: set[bytes] | None = {b""}
    closed, queries = True, []  # closed: exact is all that has been seen so far

    def flush() -> None:
        nonlocal exact, closed
        queries.append(_of_strings(exact))
        exact, closed = {b""}, False

    for op, arg in nodes:
        one, query = _letters((op, arg)), True
        if one is None and op is C.SUBPATTERN:
            one, query = _sequence(list(arg[3]))
        elif one is None and op is C.BRANCH:
            found = [_sequence(list(x)) for x in arg[1]]
            one = set().union(*[x for x, _ in found]) if all(x is not None for x, _ in found) else None
            query = _any([q if x is None else _all([q, _of_strings(x)]) for x, q in found]) if one is None else True
        elif one is None and op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = arg
            strings, inside = _sequence(list(inner))
            if strings is not None and most <= 2:
                one = {b""} if not least else set(strings)
                for n in range(1, most + 1):
                    longer = {b""}
                    for _ in range(n):
                        longer = {a + b for a in longer for b in strings}
                    one = one | longer if n >= least else one
                one = one if len(one) <= MOST_STRINGS else None
            if one is None and least:
                query = inside if strings is None else _of_strings(strings)
        elif one is None and op is C.AT:
            one = {b""}
        if one is None:
            flush()
            queries.append(query)
        else:
            if len(exact) * len(one) > MOST_STRINGS:
                flush()
            exact = {a + b for a in exact for b in one}
    if closed and len(exact) <= MOST_STRINGS:
        return exact, True
    flush()
    return None, _all(queries)


def trigram_query(pattern: str) -> object:
    """What trigrams of its lower-cased UTF-8 bytes any text with a match has."""
    strings, query = _sequence(list(parser.parse(pattern)))
    return query if strings is None else _of_strings(strings)


def trigrams(query: object) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


# --- the index --------------------------------------------------------------------------------------------------------


class Index:
    """Postings of the asked-for trigrams over a block of texts."""

    def __init__(self, asked: set[bytes]) -> None:
        self.number = {int.from_bytes(t, "big"): k for k, t in enumerate(sorted(asked))}
        self.wanted = np.zeros(1 << 24, np.uint8)
        self.wanted[list(self.number)] = 1

    def add(self, texts: list[bytes]) -> None:
        self.n = len(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        block = np.frombuffer(b"\xff".join(texts), np.uint8)  # 0xff is in no UTF-8 text
        self.postings: dict[int, np.ndarray] = {}
        if len(block) < 3 or not self.number:
            return
        code = block[:-2].astype(np.uint32) << 8
        code |= block[1:-1]
        code <<= 8
        code |= block[2:]
        hits = np.flatnonzero(self.wanted[code])
        if not len(hits):
            return
        owner, code = np.searchsorted(ends, hits, "right"), code[hits]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], len(code)], strict=True):
            self.postings[int(code[a])] = np.unique(owner[a:b])

    def find(self, query: object) -> np.ndarray:
        """Numbers of the texts that may hold a match."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(int.from_bytes(query, "big"), np.empty(0, np.int64))
        parts = sorted((self.find(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(k, r, re.compile(r.pattern), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        self.index = Index(set().union(*[trigrams(q) for *_, q in self.rules]))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of the good matches of each text, sorted."""
        self.index.add([t.encode("utf-8", "replace").lower() for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, rule, pattern, query in self.rules:
            for n in self.index.find(query).tolist():
                found[n] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[n]) if rule.good(m)]
        for f in found:
            f.sort()
        return found


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = [r.kind for r in RULES]
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for part in slices(b.column(1).to_pylist()):
                for f in scanner.scan(part):
                    base = [x for x in f if kinds[x[1]] in BASE]
                    for k in range(3):
                        cols[k].append(sum(x[1] == k for x in base))
                    listed = [",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in xs) for xs in (base, f)]
                    cols[3].append(hashlib.sha256(listed[0].encode()).hexdigest())
                    cols[4].append(listed[1])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"))

import hashlib
import re

from loomsearch.llm import secrets

from .helpers import SMALL, documents, needs_tables

BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(BASE) for m in p.finditer(text or "") if good(m))
    listed = [f"{BASE[k][0]}:{s}:{e}" for s, k, e in found]
    return tuple(sum(k == x for _, x, _ in found) for k in range(3)), hashlib.sha256(",".join(listed).encode()).hexdigest(), listed


def check(rows):
    for r in rows:
        counts, digest, listed = brute(r["text"])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == counts, r["text"][:200]
        assert r["base_sha256"] == digest
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(listed) <= set(spans) and spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), KINDS.index(s.split(":")[0])))


KINDS = [r.kind for r in secrets.RULES]
TEXTS = [
    None, "", "nothing here", 'PassWord = "hunter22"', "password: short", "secret:abcdef token=ghijkl", "api_key='AKIA" + "A1" * 10 + "'", "AKIAAKIA" + "Z" * 20, "x" + "0123456789abcdef" * 2 + "g",
    "a" * 23 + " " + "b" * 24, "\U0001f600 é token=abc123 \U0001f600 " + "f" * 40, "paſword=abcdef toKen=abcdef", "password=password=abcdef", "tokensecret=xx apikey=1234567", "ghp_" + "a" * 36,
    "word " * 30000 + "secret = abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "secret:abcdef token=ghijkl", "password" + " " * 5000 + "x", "tok\nen=abcdef",
]


def test_edges_against_brute_force(spark):
    docs = documents(spark, *TEXTS)
    check(docs.select("doc_id", "text").join(secrets.scanned(docs), "doc_id").collect())
    assert secrets.scanned(docs).count() == len(TEXTS)


@needs_tables
def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(docs.select("doc_id", "text").join(secrets.op2_secret_scan(spark, SMALL), "doc_id").collect())


def test_added_kinds(spark):
    texts = ["ghp_" + "a" * 36, "xoxb-1234567890-ab", "AIza" + "b" * 35, "sk_live_" + "c" * 24, "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10, "-----BEGIN PRIVATE KEY-----"]
    got = [r["spans"] for r in secrets.scanned(documents(spark, *texts)).orderBy("doc_id").collect()]
    for kind, spans in zip(("github", "slack", "google", "stripe", "jwt", "private"), got, strict=True):
        assert kind in spans


def test_empty_table_null_ids_and_repeats(spark):
    docs = documents(spark, "token=abcdef", "token=abcdef", None, ids=[None, None, None])
    assert secrets.scanned(docs).count() == 3
    assert secrets.scanned(docs.limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("abcd") == ("and", (b"abc", b"bcd"))
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigrams(secrets.trigram_query("(?:abc|xyz)+q")) == {b"abc", b"xyz"}
    assert secrets.trigram_query("ab?") is True
    assert secrets.trigram_query("[aA][bB][cC]") == b"abc"


def test_index_finds_every_text_that_matches():
    scanner = secrets.Scanner()
    texts = [t or "" for t in TEXTS]
    scanner.index.add([t.encode("utf-8", "replace").lower() for t in texts])
    for _, rule, pattern, query in scanner.rules:
        hits = set(scanner.index.find(query).tolist())
        assert {k for k, t in enumerate(texts) if any(map(rule.good, pattern.finditer(t)))} <= hits
    scanner.index.add([])
    assert len(scanner.index.find(b"abc")) == 0


def test_blocks_without_any_trigram_that_is_asked_for():
    scanner = secrets.Scanner()
    for texts in (["zzz zzz"], ["abc"], ["1234"], ["the"], [""], ["", "ab", "zz zz"]):
        assert scanner.scan(texts) == [[] for _ in texts]
        assert len(scanner.index.find(b"abc")) == 0
    hit = "token=abcdef"
    assert scanner.scan([hit])[0] and scanner.scan(["zzz"]) == [[]] and scanner.scan(["zzz", hit])[1]


def test_last_slice_without_hits(spark, monkeypatch):
    monkeypatch.setattr(secrets, "slices", lambda texts: ([t] for t in texts))
    docs = documents(spark, "token=abcdef", "zzz zzz", "the", "f" * 24, "1234").coalesce(1)
    check(docs.select("doc_id", "text").join(secrets.scanned(docs), "doc_id").collect())

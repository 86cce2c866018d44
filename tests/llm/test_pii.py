import hashlib
import math
import random
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from loomsearch.llm import pii

from .helpers import SMALL, documents, needs_tables


def luhn(d):
    return sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 if int(x) > 4 else 2 * int(x)) for i, x in enumerate(reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(digits(s)) <= 15),
)


def brute(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(BASE) for m in p.finditer(text or "") if good(m[0]))
    listed = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in found)
    return *[sum(x == k for _, x, _ in found) for k in range(4)], hashlib.sha256(listed.encode()).hexdigest(), listed


TEXTS = [
    None, "", "nobody", "a@b.c", "x.y+z@a-b.co.uk, q@w.e", "a@b@c.com", "a@b.com_x@c.org", "a@b.com.x@c.org", "@a.b c@d e@f.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255", "1..2.3.4.5", "9999999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111 1111 1111 1112", "4111111111111111 4111111111111111", "+49 (30) 123-4567 89", "+1 2", "++49301234567", "+49 30 1234567)", "\U0001f600 é a@b.co \U0001f600 +4930 1234567", "a" * 20000 + "@b.co", "1" * 20000,
    "+1" + "(" * 5000, "%%%@x.y", "a@b.c", "x@y.z" * 3, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "A@B.Cİ", "müller@x.de",
]


def check(rows):
    for r in rows:
        *counts, digest, listed = brute(r["text"])
        assert [r[f"n_{k}"] for k in pii.KINDS] == counts, (r["text"] or "")[:200]
        assert r["base_sha256"] == digest
        assert ",".join(s for s in r["spans"].split(",") if s and not s.startswith("term:")) == listed


def test_edges_against_brute_force(spark):
    docs = documents(spark, *TEXTS)
    check(docs.select("doc_id", "text").join(pii.scan(docs), "doc_id").collect())


@needs_tables
def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(docs.select("doc_id", "text").join(pii.op3_pii(spark, SMALL), "doc_id").collect())


def words_of(text):
    return [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{M}]{2,}", text)]


def brute_terms(texts, alpha=pii.ALPHA, level=pii.LEVEL):
    """The term spans of each text, from the definition."""
    keys, words = [], []
    for t in texts:
        found = {(k, m[0].lower()) for k, (_, p, good) in enumerate(BASE) for m in p.finditer(t) if good(m[0])}
        own = {(k, hit if k < 2 else digits(hit)) for k, hit in found}
        keys.append(own | {(k, "wide", (hit.split("@")[-1], ".".join(hit.split(".")[:3]), hit[:6], hit[:-7])[k]) for k, hit in own})
        words.append({w for *_, w in words_of(t)})
    n, n_c, n_t = len(texts), Counter(c for x in keys for c in x), Counter(w for x in words for w in x)
    n_ct, tests = Counter((c, w) for x, y in zip(keys, words, strict=True) for c in x if 1 < n_c[c] < n for w in y), Counter()
    for x, y in {t: (x, y) for t, x, y in zip(texts, keys, words, strict=True)}.values():
        tests.update({c: len(y) for c in x})
    told = set()
    for (c, w), k in n_ct.items():
        chance = n_c[c] * n_t[w] / n
        informs = math.log2(n * k / (n_c[c] * n_t[w])) >= alpha * math.log2(n / n_c[c])
        if k > 1 and informs and k > chance and k * math.log(k / chance) - k + chance >= math.log(tests[c] / level):
            told.add((c, w))
    out = []
    for t, x in zip(texts, keys, strict=True):
        base = [(m.start(), m.end()) for _, p, good in BASE for m in p.finditer(t) if good(m[0])]
        out.append([f"term:{s}:{e}" for s, e, w in words_of(t) if any((c, w) in told for c in x) and not any(s < f and b < e for b, f in base)])
    return out


def term_spans(df):
    return [[s for s in r["spans"].split(",") if s.startswith("term:")] for r in df.collect()]


def corpus(spark):
    """Five texts in which one name stands with one address, and others in which neither does."""
    told = [f"Contact Quibblethorn {'or anybody else who works there ' * 9}at q.thorn@corp.example about {w}." for w in ("budget", "travel", "hiring", "design", "legal")]
    return documents(spark, *told, *[f"Some words about {a}{b} nothing at all, or contact anybody else who works there." for a in "abcdefghij" for b in "abcdefghij"])


def test_disclosive_terms(spark):
    docs = corpus(spark)
    spans = term_spans(pii.scan(docs).orderBy("doc_id"))
    assert all(s == ["term:8:20"] for s in spans[:5]) and not any(spans[5:])
    assert spans == brute_terms([r["text"] for r in docs.orderBy("doc_id").collect()])


def test_disclosive_terms_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeéfgh", k=rng.randint(2, 6))) for _ in range(300)]
    texts = []
    for _ in range(150):
        who = rng.randrange(12)
        words = rng.choices(vocabulary, k=rng.randint(0, 30))
        if rng.random() < 0.5:
            words += [f"p{who}@mail{who % 4}.example.com", f"10.0.{who % 3}.{who}", "+49 30 1234567", "4111 1111 1111 1111"][: rng.randint(1, 4)] + [f"Name{'abcdefghijkl'[who]}x"] * rng.randint(0, 2)
        rng.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:20] + ["", "name a@b.co " * 3]
    got = term_spans(pii.scan(documents(spark, *texts)).orderBy("doc_id"))
    assert got == brute_terms(texts) and sum(map(bool, got)) > 10


@needs_tables
def test_query_terms_against_brute_force(spark):
    folder = SMALL.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op3_pii(spark, folder).orderBy("doc_id").collect()
    spans = [[s for s in r["spans"].split(",") if s.startswith("term:")] for r in got]
    assert spans == brute_terms([texts[r["doc_id"]] for r in got])
    assert any(spans) and not any(s for r, s in zip(got, spans, strict=True) if not sum(r[f"n_{k}"] for k in pii.KINDS))


def test_one_document_never_tells(spark):
    docs = documents(spark, "Contact Quibblethorn at q.thorn@corp.example now.", *["plain words"] * 2000)
    assert not any(term_spans(pii.scan(docs)))


def test_sanitise(spark):
    docs = corpus(spark)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert got[0].startswith("Contact [TERM] or anybody") and got[0].endswith(" at [EMAIL] about budget.") and got[5:] == [r["text"] for r in docs.orderBy("doc_id").collect()][5:]
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    left = pii.scan(out).agg(*[F.sum(f"n_{k}").alias(k) for k in pii.KINDS]).first()
    assert sum(left) == 0


def test_overlapping_spans_are_merged(spark):
    docs = documents(spark, "card 4111 1111 1111 1111 and +4111111111111111", "1.2.3.4@x.yz", None)
    a, b, c = [r["text"] for r in pii.sanitise(docs).orderBy("doc_id").collect()]
    assert a.startswith("card [CARD] and ") and not re.search("[0-9]", a) and b == "[EMAIL]" and c is None


def test_empty_table_null_ids_and_repeats(spark):
    docs = documents(spark, "a@b.co", "a@b.co", None, ids=[None, None, 3])
    assert sorted(r["n_email"] for r in pii.scan(docs).collect()) == [0, 1, 1]
    assert pii.sanitise(docs).count() == 3
    assert pii.scan(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0

"""Personal data: patterns with checks, and terms that give protected entities away.

Base entities are found by pattern.  What a term gives away is estimated from
the corpus.  For an entity c and a term t,

    PMI(c; t) = log2(N * n(c, t) / (n(c) * n(t)))      IC(c) = log2(N / n(c))

where N, n(c), n(t) and n(c, t) all count documents: all of them, those with
the entity, with the term, and with both.  Every letter run of two or more code
points in a whole document is a term of it.  An entity is an exact value, and
also the wider one that it belongs to: an address's domain, a network, a card
issuer, a number's region.  A term tells too much when

    PMI(c; t) >= ALPHA * IC(c)

and when chance does not explain that the two meet so often: the tail of a
Poisson distribution with mean E = n(c) * n(t) / N, by its bound
exp(n(c, t) - E) * (E / n(c, t)) ** n(c, t), is at most ``LEVEL`` divided by the
number of terms in the documents of the entity.  One document alone never
passes that test, at any size.  In the documents that hold the entity, every
occurrence of such a term outside of base entities is a span of kind ``term``,
and ``sanitise`` replaces it by a general class, as it does with entities.

Everything is column expressions.  Entity texts that are copies are examined
once, with their number.  Entities that occur in the same documents have the
same terms, so that they are counted as one class, however many a document
lists.  Positions come from the pieces between matches, whose
lengths add up; the patterns are written with possessive repeats and
look-behinds that skip only starts from which a match would have begun
earlier, so that no text makes them slow.

Defined results: a null text counts as empty and has no spans; a very long text
is searched whole; spans that start at one place stand in the order of the
kinds, a term last; a row with a null doc_id is processed like any other;
repeated rows count as documents and each get the same result; no rows give no
rows; other columns are ignored, or kept as they are by ``sanitise``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_row, let, materialize, read, small_side, whole_text

LOCAL = r"A-Za-z0-9._%+-"
#: kind -> (pattern, a cheap test that any text with a match passes).
PATTERNS = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]")),
}
KINDS = tuple(PATTERNS)
#: Share of an entity's information that makes a term disclosive, and chance terms for each entity.
ALPHA, LEVEL = 0.8, 0.05
#: Letter runs; ``TERM`` finds those that are terms, ``NO_TERM`` what is between runs.
TERM, NO_TERM = r"[\p{L}\p{M}]{2,}+", r"[^\p{L}\p{M}]+"
SPAN = "struct<start:int,end:int,hit:string>"


def spans(text: Column, pattern: str, wanted: Callable[[Column], Column] = lambda hit: F.lit(True)) -> Column:
    """(start, end, hit) of every wanted match, leftmost and non-overlapping, in code points."""

    def place(hits: Column, gaps: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + F.length(pair["gap"])
            end = start + F.length(pair["hit"])
            longer = F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit")))
            return F.struct(end.alias("at"), F.when(wanted(pair["hit"]), longer).otherwise(acc["out"]).alias("out"))

        pairs = F.transform(hits, lambda h, i: F.struct(h.alias("hit"), F.get(gaps, i).alias("gap")))
        return F.aggregate(pairs, zero, step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda gaps: place(hits, gaps))).otherwise(F.array().cast(f"array<{SPAN}>")))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: (lambda v: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))(F.try_to_number(d, F.lit("9")).cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda d: (F.length(d) <= 3) & (F.lpad(d, 3, "0") <= "255")))
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(14, 19), let(_digits(hit), _luhn)).otherwise(False)
    return F.length(_digits(hit)).between(10, 15)


def entities(text: Column) -> Column:
    """All base spans as (start, k, end, hit), sorted by start and then by kind."""
    found = []
    for k, kind in enumerate(KINDS):
        pattern, may = PATTERNS[kind]
        good = F.filter(spans(text, pattern), lambda s: _valid(kind, s["hit"]))
        as_rows = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), s["hit"].alias("hit")))
        found.append(F.when(may(text), as_rows).otherwise(F.array().cast("array<struct<start:int,k:int,end:int,hit:string>>")))
    return F.sort_array(F.concat(*found))


# --- terms ------------------------------------------------------------------------------------------------------------


def _entity_keys(e: Column) -> Column:
    """The exact and the wider entity of a base span."""
    hit, digits = F.lower(e["hit"]), _digits(e["hit"])
    wider = F.when(e["k"] == 0, F.concat(F.lit("0@"), F.substring_index(hit, "@", -1))).when(e["k"] == 1, F.concat(F.lit("1/"), F.substring_index(hit, ".", 3)))
    wider = wider.when(e["k"] == 2, F.concat(F.lit("2#"), F.substring(digits, 1, 6))).otherwise(F.concat(F.lit("3+"), F.substring(digits, F.lit(1), F.length(digits) - 7)))
    return F.array(F.concat(e["k"].cast("string"), F.lit(":"), F.when(e["k"] < 2, hit).otherwise(digits)), wider)


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), NO_TERM), lambda w: F.length(w) >= 2))


def entity_texts(docs: DataFrame) -> DataFrame:
    """(h, times, t, base, keys, terms) of each different text with an entity: its copies, spans, entities and terms."""
    some = F.explode(F.filter(F.array(entities(F.col("t"))), lambda e: F.size(e) > 0))  # a filter on the entities would find them once more
    found = docs.select(whole_text().alias("t")).where(F.col("t").rlike("[0-9@]")).select("t", some.alias("base"))
    found = found.groupBy(F.xxhash64("t").alias("h")).agg(F.count(F.lit(1)).alias("times"), F.first(F.struct("t", "base")).alias("o"))
    keys = F.array_distinct(F.flatten(F.transform("o.base", _entity_keys)))
    return found.select("h", "times", "o.t", "o.base", keys.alias("keys"), terms(F.col("o.t")).alias("terms"))


def _too_much(n: float, n_t: Column, alpha: float, level: float) -> Column:
    """Whether ``n_ct`` meetings of an entity in ``n_c`` documents and a term in ``n_t`` tell too much."""
    n_c, n_ct, tests = F.col("n_c"), F.col("n_ct"), F.greatest(F.col("tests"), F.lit(1))
    chance = n_c * n_t / F.lit(n)
    informs = F.log2(F.lit(n) * n_ct / (n_c * n_t)) >= alpha * F.log2(F.lit(n) / n_c)
    return informs & (n_ct > chance) & (n_ct * F.ln(n_ct / chance) - n_ct + chance >= F.ln(tests / F.lit(level)))


def entity_classes(found: DataFrame, n: float, scratch: Scratch) -> DataFrame:
    """(h, class, n_c): the classes of entities with the same documents, in each text; without those of one document or of all."""
    each = found.select("h", "times", F.explode("keys").alias("key"))
    where = F.struct(F.sum("times").alias("n_c"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y")).alias("w")
    keys = each.groupBy("key").agg(where).where((F.col("w.n_c") > 1) & (F.col("w.n_c") < n))
    keys = scratch.keep(keys.select("key", F.xxhash64("w").alias("class"), "w.n_c"), "pii-entities")
    return each.join(small_side(keys, keys.count()), "key").select("h", "class", "n_c").distinct()


def disclosive(docs: DataFrame, n: float, found: DataFrame, classes: DataFrame, scratch: Scratch, alpha: float = ALPHA, level: float = LEVEL) -> DataFrame:
    """(class, term) pairs in which the term tells too much of the entities; ``n`` is the number of documents."""
    tests = classes.join(found.select("h", F.size("terms").alias("m")), "h").groupBy("class").agg(F.sum("m").alias("tests"))
    met = classes.join(found, "h").select("class", "n_c", "times", F.explode("terms").alias("term"))
    met = met.groupBy("class", "n_c", "term").agg(F.sum("times").alias("n_ct")).where(F.col("n_ct") > 1).join(tests, "class")
    # a term occurs in no fewer documents than it does in those with entities: what falls short with that number goes at once
    met = met.where(_too_much(n, F.col("n_ct"), alpha, level))
    near = found.select("times", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("times").alias("n_near"))
    met = scratch.keep(met.join(near, "term").where(_too_much(n, F.col("n_near"), alpha, level)).drop("n_near"), "pii-pairs")
    words = docs.select(F.explode(terms(whole_text())).alias("term"))
    n_t = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))  # combined before the exchange: each task sends a word once
    return met.join(n_t, "term").where(_too_much(n, F.col("n_t"), alpha, level)).select("class", "term")


def term_spans(text: Column, told: Column, base: Column) -> Column:
    """Spans of the terms ``told`` in ``text`` that meet no base span."""
    hits = spans(text, TERM, lambda hit: F.array_contains(told, F.lower(hit)))
    apart = F.filter(hits, lambda s: ~F.exists(base, lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"])))
    return F.transform(apart, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("k"), s["end"].alias("end"), s["hit"].alias("hit")))


def disclosed(docs: DataFrame, alpha: float = ALPHA, level: float = LEVEL) -> tuple[DataFrame, int]:
    """(h, terms): the spans of disclosive terms of each text that has some, and how many there are."""
    scratch, n = Scratch(docs.sparkSession), float(docs.count())
    found = scratch.keep(entity_texts(docs), "pii-texts")
    classes = scratch.keep(entity_classes(found, n, scratch), "pii-classes")
    told = scratch.keep(disclosive(docs, n, found, classes, scratch, alpha, level), "pii-told")
    n_told = told.count()
    each = classes.join(small_side(told.select("class").distinct(), n_told), "class", "left_semi").join(found, "h").select("h", "class", F.explode("terms").alias("term"))
    each = each.join(small_side(told, n_told), ["class", "term"], "left_semi").groupBy("h").agg(F.collect_set("term").alias("told"))
    by_text = each.join(found, "h").select("h", term_spans(F.col("t"), F.col("told"), F.col("base")).alias("terms"))
    by_text = materialize(by_text, "pii-by-text")
    scratch.drop()
    return by_text, by_text.agg(F.sum(F.size("terms"))).first()[0] or 0


NO_SPANS = "array<struct<start:int,k:int,end:int,hit:string>>"


def with_terms(df: DataFrame, by_text: DataFrame, n_spans: int) -> DataFrame:
    """``df`` (__h and others) with __terms, the spans of disclosive terms."""
    side = small_side(by_text.withColumnsRenamed({"h": "__k", "terms": "__terms"}), n_spans)
    return df.join(side, F.col("__h") == F.col("__k"), "left").drop("__k").withColumn("__terms", F.coalesce("__terms", F.array().cast(NO_SPANS)))


def listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, and all spans."""
    t = whole_text()
    base = F.when(t.rlike("[0-9@]"), entities(t)).otherwise(F.array().cast(NO_SPANS))
    df = with_terms(docs.select("doc_id", F.xxhash64(t).alias("__h"), base.alias("__base")), *disclosed(docs))  # no texts are exchanged
    counts = [F.size(F.filter("__base", lambda s: s["k"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(F.sort_array(F.concat("__base", "__terms"))).alias("spans"))


GENERAL = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")


def redacted(text: Column, found: Column) -> Column:
    """``text`` with each span replaced by its class; a span that starts inside an earlier one is merged into it."""
    names = F.array(*[F.lit(k) for k in GENERAL])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["k"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with entities and disclosive terms in text generalised; n_chars follows where there is one."""
    df, t = as_row(docs, "text"), whole_text()
    found = F.when(t.rlike("[0-9@]"), entities(t)).otherwise(F.array().cast(NO_SPANS))
    plain = df.where(F.size(found) == 0).select("__row.*")
    some = F.explode(F.filter(F.array(found), lambda e: F.size(e) > 0)).alias("__base")
    df = with_terms(df.select("__row", "text", F.xxhash64(t).alias("__h"), some), *disclosed(docs))  # only texts with entities are exchanged
    df = df.withColumn("__new", redacted(F.col("text"), F.sort_array(F.concat("__base", "__terms"))))
    new = {"text": F.col("__new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__new").cast(docs.schema["n_chars"].dataType)
    return plain.unionByName(df.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`") for c in docs.columns]))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))

"""Quality rules: text statistics, fixed limits, and a learned decision list.

The statistics are column expressions over the whole text.  The decision list
is learned by sequential covering: a rule is grown condition by condition on
one part of the labelled rows for the largest information gain, pruned from
its end on the other part, and the rows it covers are set aside before the
next rule is grown.  What comes out is an ordered CASE expression.

Defined results: a null text counts as an empty one and fails the fixed limit;
a very long text is counted whole; of conditions that gain equally, the first
feature's lowest threshold is taken, and of prunings the longest rule; a
document with both labels counts as bad; repeated rows are judged one by one; without labelled rows of both kinds no
rule is learned and only the fixed limits decide; columns that the operator
does not need are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, let, read, whole_text

SPACE = r"[\x20\x09-\x0D]+"
#: Labelled rows that a decision list is fitted on, at most; the rest of the table only gets judged.
FIT_ROWS = 6000
#: Rules in a list and conditions in a rule, at most.
MAX_RULES, MAX_CONDITIONS = 12, 4
#: Share of a rule's covered rows on the pruning part that must be bad, so that good documents stay.
MIN_PRECISION = 0.9

FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "punct_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share", "line_words")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text."""

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
            return F.filter(same, lambda i: i.isNotNull())

        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = let(ranked, places)
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(hashes, count)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__quality`` of the base counts and the features of the rules."""
    t = F.col("__t")
    left_out = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    kept = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    df = docs.withColumn("__t", whole_text(text)).withColumn("__w", words(t))
    counts = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": left_out("#*$%&|<>"),
        "n_dup_lines": duplicate_lines(t),
        "n_repeat_words": repeated_words(F.col("__w")),
        "n_upper": kept(r"[^\p{Lu}]+"),
        "n_punct": kept(r"[\p{L}\p{M}\p{N}\s]+"),
        "n_digits": kept(r"[^0-9]+"),
        "n_distinct": F.size(F.array_distinct("__w")),
        "n_lines": F.size(F.split(t, "\n")),
    }
    df = df.withColumn("__c", F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))
    c = F.col("__c")
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
    features = {
        "f_n_words": c["n_words"].cast("double"), "f_mean_word": share(c["word_chars"], c["n_words"]), "f_symbol_share": share(c["n_symbols"], c["word_chars"]),
        "f_upper_share": share(c["n_upper"], c["word_chars"]), "f_punct_share": share(c["n_punct"], c["word_chars"]), "f_digit_share": share(c["n_digits"], c["word_chars"]),
        "f_dup_line_share": share(c["n_dup_lines"], c["n_lines"]), "f_repeat_share": share(c["n_repeat_words"], c["n_words"]), "f_distinct_share": share(c["n_distinct"], c["n_words"]),
        "f_line_words": share(c["n_words"], c["n_lines"]),
    }
    return df.withColumn("__quality", F.struct(c["n_words"].alias("n_words"), *[c[k].alias(k) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], *[v.alias(k) for k, v in features.items()])).drop("__t", "__w", "__c")


@dataclass(frozen=True)
class Rule:
    """Rejects a document for which every (feature, is_above, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: np.ndarray, names: tuple[str, ...] = FEATURES) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, above, limit in self.conditions:
            col = x[:, names.index(name)]
            hit &= (col > limit) if above else (col <= limit)
        return hit

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, above, limit in self.conditions:
            col = stats[f"f_{name}"]
            out = out & ((col > F.lit(limit)) if above else (col <= F.lit(limit)))
        return out


def _grow(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> Rule:
    conditions: list[tuple[str, bool, float]] = []
    hit = np.ones(len(x), bool)
    while len(conditions) < MAX_CONDITIONS and (~bad[hit]).any():
        p0, n0 = bad[hit].sum(), (~bad[hit]).sum()
        best = (1e-9, None)
        for k, name in enumerate(names):
            col = x[hit, k]
            cuts = np.unique(np.quantile(np.unique(col), np.linspace(0, 1, 65)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            for limit in cuts:
                up = col > limit
                for above, side in ((True, up), (False, ~up)):
                    p, n = (bad[hit] & side).sum(), (~bad[hit] & side).sum()
                    if p and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best[0]:
                        best = (gain, (name, above, float(limit)))
        if best[1] is None:
            break
        conditions.append(best[1])
        hit = Rule(tuple(conditions)).covers(x, names)
    return Rule(tuple(conditions))


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> tuple[Rule, float]:
    def worth(r: Rule) -> tuple[float, float]:
        hit = r.covers(x, names)
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        return ((p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0)

    options = [Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)]
    best = max(options, key=lambda r: worth(r)[0], default=rule)
    return best, worth(best)[1] if best.conditions else 0.0


def learn(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = FEATURES) -> list[Rule]:
    """A decision list from features and labels; rows at every third place prune what the others grew."""
    rules: list[Rule] = []
    pruning = np.arange(len(x)) % 3 == 2
    while len(rules) < MAX_RULES and bad[~pruning].any() and (~bad).any():
        rule, precision = _prune(_grow(x[~pruning], bad[~pruning], names), x[pruning], bad[pruning], names)
        hit = rule.covers(x, names)
        if not rule.conditions or precision < MIN_PRECISION or not (hit & bad).any():
            break
        rules.append(rule)
        x, bad, pruning = x[~hit], bad[~hit], pruning[~hit]
    return rules


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from the documents that ``labels`` marks with quality 0 or 1.

    The sample is the ``fit_rows`` labels that come first by a hash of their
    id, a bound that does not depend on the table's size.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("__bad")).orderBy(*order, "__bad").limit(fit_rows)
    picked = picked.groupBy("doc_id").agg(F.min("__bad").alias("__bad"))
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")).select("doc_id", "__bad", *[F.col(f"__quality.f_{n}").alias(n) for n in FEATURES])
    table = rows.orderBy(*order, *FEATURES).limit(fit_rows).toPandas()
    return learn(table[list(FEATURES)].to_numpy(float).reshape(len(table), len(FEATURES)), table["__bad"].to_numpy() == 0)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """True for documents that stay: the fixed limits first, then the rules in their order."""
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(stats), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the five counts, base_failed and kept for each row."""
    q = F.col("__quality")
    df = statistics(docs.select("doc_id", "text"))
    return df.select("doc_id", *[q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(q).alias("base_failed"), verdict(q, rules).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    A generator drops the others: a filter would be pushed below the statistics
    with a copy of them for each time that it names one.
    """
    keep = F.explode(F.filter(F.array(verdict(F.col("__quality"), rules)), lambda x: x))
    return statistics(as_row(docs, "text")).select("__row", keep.alias("__keep")).select("__row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels")))

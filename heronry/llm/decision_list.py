"""Quality rules as a learned decision list.

Every text gets a few statistics. Sequential covering learns rules for low quality from those of labelled rows: a rule
is grown condition by condition (feature above or below a threshold, by information gain over the rows still
uncovered), pruned on rows kept apart, and accepted while it is precise there; covered rows leave and the next rule is
sought. The list becomes one ordered conditional expression over the statistics.

All statistics and verdicts are Spark expressions within a row, so no text moves. Learning sees the statistics of at
most SAMPLE rows of each label.

Defined results: a null text, an empty one and one of separators only have no word and fail the base rule; without
labelled rows of both kinds the list is empty and keeps what the base rule passes; rows without an id are judged like
any other; repeated rows get equal results; a document labelled both good and bad counts as bad; a very long text costs
time in proportion to its length, long runs of white space too; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bounded_sample, fold_crc, table

SAMPLE = 1500
#: Cut points tried for each feature, conditions of a rule, rules of a list, and a rule's least precision on rows kept apart.
CUTS, DEPTH, RULES, PRECISE = 24, 3, 8, 0.9
#: The share of a rule's bad rows that it must still cover when its thresholds are moved away from the good ones.
KEPT = 0.97
#: The share of all bad rows that a rule must cover at least; rules for fewer would fit the sample.
SUPPORT = 0.05
WINDOW = 5
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit("\x20\t\n\x0b\x0c\r"))  # in one pass: a pattern for the end would be tried again at every blank of a run
    words = F.when(F.length("body") > 0, F.split("body", rf"[{SPACE}]+")).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", text.alias("text")).withColumn("body", trimmed)
    rows = rows.select(
        "doc_id",
        words.alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(rf"[^{SPACE}]")).alias("lines"),
        F.length(F.regexp_replace("body", rf"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("body", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("body", F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
    )
    rows = rows.select("*", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    at = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashes = F.when(F.size("words") >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])))
    rows = rows.withColumn("hashes", hashes).drop("lines", "words")
    repeated = F.size("hashes") > F.size(F.array_distinct("hashes"))
    paired = F.when(repeated, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("paired", paired).drop("hashes")
    # In order of hash, a window is repeated if a neighbour has its hash; the words that repeated windows cover follow from their places.
    twice = F.filter("paired", lambda x, i: (F.get("paired", i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get("paired", i + 1)["h"].eqNullSafe(x["h"]))
    rows = rows.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("paired")
    covered = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]
    rows = rows.select("doc_id", F.struct(*STATISTICS[:-1], F.coalesce(covered, F.lit(0)).cast("long").alias(STATISTICS[-1])).alias("s"))
    # A filter on a statistic must not be pushed down and so computed once for each of its mentions: generated columns hold it back.
    return rows.select("doc_id", F.explode(F.array("s")).alias("s")).select("doc_id", "s.*")


def features() -> dict[str, Column]:
    per = lambda n, of: F.col(n) / F.greatest(F.col(of), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"), "symbols_a_word": per("n_symbols", "n_words"), "marks_a_word": per("n_marks", "n_words"),
        "capital_share": per("n_capitals", "word_chars"), "repeated_share": per("n_repeat_words", "n_words"), "repeated_lines": per("n_dup_lines", "n_lines"), "words_a_line": per("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: float) -> bool:
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def _bits(flags) -> int:
    return sum(1 << k for k, x in enumerate(flags) if x)


def _candidates(rows: list[dict[str, float]]) -> list[Condition]:
    out = []
    for name in sorted(rows[0]) if rows else []:
        values = sorted({r[name] for r in rows})
        middles = [(a + b) / 2 for a, b in zip(values, values[1:])]
        tried = middles if len(middles) <= CUTS else [middles[(2 * k + 1) * len(middles) // (2 * CUTS)] for k in range(CUTS)]
        # Quantiles of the rows, too, so that a feature's common range is cut as finely as its tail.
        ordered = sorted(r[name] for r in rows)
        tried += [ordered[(2 * k + 1) * len(ordered) // (2 * CUTS)] for k in range(CUTS)]
        out += [Condition(name, above, t) for t in sorted(set(tried)) for above in (False, True)]
    return out


def learn_rules(rows: list[dict[str, float]], bad: list[bool]) -> list[tuple[Condition, ...]]:
    """Ordered rules, each a conjunction that tells bad rows. Two rows of three grow rules, the third prunes them."""
    if not any(bad) or all(bad):
        return []
    pool = _candidates(rows)
    held = {c: _bits(c.holds(r[c.feature]) for r in rows) for c in pool}
    is_bad, prune = _bits(bad), _bits(k % 3 == 2 for k in range(len(rows)))
    everything = (1 << len(rows)) - 1
    left, rules = everything, []

    def counts(mask: int) -> tuple[int, int]:
        return (mask & is_bad).bit_count(), (mask & ~is_bad).bit_count()

    def covered(rule, mask: int) -> int:
        for c in rule:
            mask &= held[c]
        return mask

    def loosened(rule):
        """Each threshold moved as far towards rejecting less as KEPT of the bad rows that the rule covers allow: a margin for what the sample lacks."""
        rule = list(rule)
        least = KEPT * counts(covered(rule, left))[0]
        for k, c in enumerate(rule):
            others = [x for x in pool if x.feature == c.feature and x.above == c.above and counts(covered([*rule[:k], x, *rule[k + 1 :]], left))[0] >= least]
            rule[k] = max([c, *others], key=lambda x: x.threshold if x.above else -x.threshold)
        return rule

    while len(rules) < RULES:
        rule, mask = [], left & ~prune
        while len(rule) < DEPTH:
            p, n = counts(mask)
            if not p or not n:
                break
            before = math.log2(p / (p + n))
            gain = lambda c: (lambda q, m: q * (math.log2(q / (q + m)) - before) if q else 0.0)(*counts(mask & held[c]))  # noqa: E731, B023
            best = max(pool, key=lambda c: (gain(c), c.threshold if c.above else -c.threshold))  # of equal gains the condition that rejects least
            if gain(best) <= 1e-9:
                break
            rule.append(best)
            mask &= held[best]
        if not rule:
            break
        worth = lambda r: (lambda p, n: (p - n) / max(1, p + n))(*counts(covered(r, left & prune)))  # noqa: E731, B023
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        rule = loosened(rule)
        p, n = counts(covered(rule, left))
        q, m = counts(covered(rule, left & prune))
        if p < max(2, SUPPORT * is_bad.bit_count()) or p < PRECISE * (p + n) or q < PRECISE * (q + m):
            break
        rules.append(tuple(rule))
        left &= ~covered(rule, left)
        if not left & is_bad:
            break
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The number of the first rule that holds, or null: one ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def learn(docs: DataFrame, labels: DataFrame, eligible: Column) -> list[tuple[Condition, ...]]:
    """Rules from the statistics of a bounded sample of labelled rows that pass the base rule."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("_label")).where(eligible & F.col("_label").isin(0, 1)).groupBy("doc_id").agg(F.min("_label").alias("_label"))
    chosen = bounded_sample(marks, "_label", SAMPLE).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    stats = statistics(rows.select("doc_id", "text")).where(~base_failed())
    own = stats.select("doc_id", *[x.alias(n) for n, x in features().items()]).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    taken = own.orderBy(F.xxhash64("doc_id"), "doc_id").drop("_id", "doc_id").collect()
    return learn_rules([{n: x for n, x in r.asDict().items() if n != "_label"} for r in taken], [r["_label"] == 0 for r in taken])


def judge(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """doc_id, base statistics, base_failed, rule (the rule that rejects, by number) and kept of every row."""
    stats = statistics(docs).select("*", base_failed().alias("base_failed"), *[x.alias(n) for n, x in features().items()])
    ruled = stats.withColumn("rule", verdict(rules))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs, learn(docs, labels, F.coalesce(fold_crc("doc_id", 5) != 0, F.lit(False))))


SQL = None  # learned rules have no SQL form; tests hold the statistics against plain Python and the rules against held-out labels

"""Fusion, feedback, suppression, fit and packing of ranked candidates. Every order ends in a unique key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy as P


def lookup(key: Column, values: dict, default: float = 0.0) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(float(v))) for k, v in values.items()], F.lit(default))


def rounded(c: Column, places: int = 3) -> Column:
    """Half upwards, as results are shown."""
    return F.floor(c * 10**places + 0.5) / 10**places


def source_weight(source: Column, task: Column | None = None, hard: Column | None = None, item_type: Column | None = None, sure: Column | None = None) -> Column:
    """Weight of a hit: of its source, changed by the task, by whether the query names files, symbols or errors, and by the item's type (as far as sure)."""
    w = lookup(source, P.SOURCE_WEIGHTS, 1.0)
    if task is not None:
        w = w + F.coalesce(*[F.when(task == t, lookup(source, d)) for t, d in P.TASK_WEIGHTS.items()], F.lit(0.0))
    if hard is not None:
        w = w + F.when(hard & source.isin(*P.HARD_SIGNAL_SOURCES), P.HARD_SIGNAL_BONUS).when(hard & (source == "vector"), P.HARD_SIGNAL_VECTOR).otherwise(0.0)
    if task is not None and item_type is not None:
        w = reduce(lambda a, b: a + F.when((task == b[0]) & item_type.isin(*b[1]), b[2] * (F.lit(1.0) if sure is None else sure)).otherwise(0.0), P.TYPE_BOOSTS, w)
    return w


def contributions(hits: DataFrame, weight: Column, k: int = P.RRF_K) -> DataFrame:
    """hits with contribution = weight / (k + rank)."""
    return hits.withColumn("contribution", weight / (k + F.greatest(F.lit(1), F.col("rank"))))


def fuse(hits: DataFrame, weight: Column, k: int = P.RRF_K, limit: int | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """query_id, item_id, score, n_hits, rank: weighted reciprocal ranks, summed over all hits of an item, over the query's best."""
    kept = hits.where(~F.col("source").isin(*without)) if without else hits
    summed = contributions(kept, weight, k).groupBy("query_id", "item_id").agg(F.sum("contribution").alias("s"), F.count("*").alias("n_hits"))
    per = Window.partitionBy("query_id")
    scored = summed.withColumn("score", F.round(F.least(F.lit(1.0), F.col("s") / F.greatest(F.max("s").over(per), F.lit(0.0001))), 6))
    placed = scored.withColumn("rank", F.row_number().over(per.orderBy(F.col("score").desc(), "item_id")))
    return (placed if limit is None else placed.where(F.col("rank") <= limit)).select("query_id", "item_id", "score", "n_hits", "rank")


def feedback_summary(events: DataFrame) -> DataFrame:
    """Counts of each kind, latest kind and time for each item of events (event_id, item_id, feedback_type, ts)."""
    count = lambda k: F.count_if(F.col("feedback_type") == k)
    last = F.max(F.struct("ts", "event_id", "feedback_type"))
    return events.groupBy("item_id").agg(
        count("selected").alias("n_selected"), count("selected_but_noisy").alias("n_noisy"), count("rejected").alias("n_rejected"), count("irrelevant").alias("n_irrelevant"), count("stale").alias("n_stale"), last["feedback_type"].alias("latest"), F.max("ts").alias("latest_at")
    )


def feedback_factor(as_of: str) -> Column:
    """Damping of a score by a summary's negative mass, fading with the days since the latest event."""
    m = P.FEEDBACK_MASS
    mass = m["rejected"] * F.col("n_rejected") + m["stale"] * F.col("n_stale") + m["irrelevant"] * F.col("n_irrelevant") + m["selected_but_noisy"] * F.col("n_noisy") + m["selected"] * F.col("n_selected")
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("latest_at").cast("timestamp"))) / 86_400_000_000)
    recent = F.coalesce(F.exp(-days / P.FEEDBACK_DAYS), F.lit(P.FEEDBACK_UNKNOWN))
    return F.when(mass <= 0, 1.0).otherwise(P.FEEDBACK_FLOOR + (1 - P.FEEDBACK_FLOOR) * F.exp(-mass * recent))


def feedback_adjustment() -> Column:
    """Additive change of a final score by a summary."""
    return F.least(F.lit(0.1), F.col("n_selected") * 0.04) - F.least(F.lit(0.08), F.col("n_noisy") * 0.03) - F.least(F.lit(0.24), F.col("n_stale") * 0.2) - F.least(F.lit(0.18), (F.col("n_rejected") + F.col("n_irrelevant")) * 0.09)


def delta_with_floor(base: Column, factor: Column, floor: float) -> Column:
    """Change of a score by a factor that never takes it from above the floor to below."""
    damped = base * factor
    return F.when(base > floor, F.greatest(damped, F.lit(floor))).otherwise(damped) - base


def window_rerank(candidates: DataFrame, window: int) -> DataFrame:
    """candidates (query_id, item_id, rank, fused, local, overlap, trust) with final and new rank: the first `window` of each query by a given local score, the rest by the plain blend."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    trust = unit(F.col("trust") / 100)
    scored = unit(unit(F.col("local")) * 0.7 + F.col("fused") * 0.22 + trust * 0.08)
    plain = unit(P.RERANK["fused"] * F.col("fused") + P.RERANK["overlap"] * F.col("overlap") + P.RERANK["trust"] * trust)
    rows = candidates.withColumn("final", F.round(F.when(F.col("rank") <= window, scored).otherwise(plain), 6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("final").desc(), "rank", "item_id")))


def penalty_factor(delta: Column) -> Column:
    """A negative change as a factor of 0.4 to 1."""
    return F.when(delta >= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.4), F.exp(2.2 * delta))))


def stale_after(item_type: Column) -> Column:
    return F.coalesce(*[F.when(item_type == k, F.lit(v[1])) for k, v in P.FRESHNESS.items()], F.lit(365))


def suppress(score: Column, superseded: Column, stale: Column, latest: Column, hard: Column, domain_match: Column, mismatch: Column | None = None) -> Column:
    """Final score after suppression: factors for supersession, age, feedback and domain, with a floor of 0.1, then the domain boost.

    superseded: greatest confidence of a superseding edge or null; domain_match: true, false or null where no domain is known;
    mismatch: whether a candidate gives none of the evidence asked for.
    """
    factor = penalty_factor(F.when(superseded.isNotNull(), -F.least(F.lit(0.28), 0.18 + superseded * 0.08)).otherwise(0.0))
    factor = factor * penalty_factor(F.when(stale & ~hard, -0.14).otherwise(0.0))
    factor = factor * penalty_factor(F.when((latest == "stale") & ~hard, -0.1).when(latest.isin("rejected", "irrelevant") & ~hard, -0.08).otherwise(0.0))
    factor = factor * penalty_factor(F.when(~domain_match, P.DOMAIN_MISMATCH).otherwise(0.0))
    if mismatch is not None:
        factor = factor * penalty_factor(F.when(mismatch, -0.1).otherwise(0.0))
    damped = F.when(score > 0.1, F.greatest(score * factor, F.lit(0.1))).otherwise(score * factor)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), damped + F.when(domain_match, P.DOMAIN_MATCH).otherwise(0.0)))


def superseded_by(edges: DataFrame, limit: int = 8) -> DataFrame:
    """item_id, by, confidence: the strongest superseding edges of each item."""
    order = Window.partitionBy("dst").orderBy(F.col("confidence").desc(), "src")
    found = edges.where("kind = 'supersedes'").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return found.select(F.col("dst").alias("item_id"), F.col("src").alias("by"), "confidence")


def fit_status(score: Column) -> Column:
    return F.when(score >= P.READY, "ready").when(score >= P.CONFIRM, "needs_confirmation").otherwise("insufficient")


def fit(fused: DataFrame, coverage: DataFrame) -> DataFrame:
    """query_id, top1, top3, coverage, fit_score, fit_status from fused (query_id, rank, score) and coverage (query_id, coverage)."""
    top = fused.where("rank <= 3").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.avg("score").alias("top3"))
    w = P.FIT_WEIGHTS
    whole = w["top1"] + w["top3"] + w["coverage"]
    joined = top.join(coverage, "query_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    scored = joined.withColumn("fit_score", rounded((F.col("top1") * w["top1"] + F.col("top3") * w["top3"] + F.col("coverage") * w["coverage"]) / whole))
    return scored.select("query_id", F.round("top1", 6).alias("top1"), F.round("top3", 6).alias("top3"), F.round("coverage", 6).alias("coverage"), "fit_score", fit_status(F.col("fit_score")).alias("fit_status"))


def signal_coverage(signals: DataFrame, candidates: DataFrame, top: int = 6) -> DataFrame:
    """query_id, n_signals, n_covered, coverage: the share of a query's weighted signals (kind, value, weight) that one of its best candidates (rank, values) holds."""
    held = candidates.where(F.col("rank") <= top).select("query_id", F.explode("values").alias("value")).distinct().withColumn("hit", F.lit(1))
    found = signals.join(held, ["query_id", "value"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    by_kind = found.groupBy("query_id", "kind", "weight").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    return by_kind.groupBy("query_id").agg(F.sum("n").alias("n_signals"), F.sum("h").alias("n_covered"), (F.sum(F.col("weight") * F.col("h") / F.col("n")) / F.sum("weight")).alias("coverage"))


def within_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """Candidates (query_id, rank, tokens) in order of rank until the first that would exceed the budget."""
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return candidates.withColumn("used", F.sum("tokens").over(run)).where(F.col("used") <= budget)


#: Conventions that stand first in a pack, whatever their score.
PINNED = 5


def pack(candidates: DataFrame, budget: int) -> DataFrame:
    """query_id, section, item_id, tokens: candidates (query_id, rank, item_id, tokens and, if there are conventions, a boolean column of that name) in three sections by greedy choice.

    The first PINNED conventions come first of all, beyond the number of items of their section; what they take is gone from its
    budget. A section skips what does not fit and goes on; what it takes is gone for the next one. Candidates of a query are few,
    since search limits them.
    """
    budget = max(900, budget)
    first, second = -(-budget * 52 // 100), -(-budget * 34 // 100)
    rows = candidates if "convention" in candidates.columns else candidates.withColumn("convention", F.lit(False))
    rows = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "tokens", "convention"))).alias("all"))
    rows = rows.withColumn("pinned", F.slice(F.filter("all", lambda c: c["convention"]), 1, PINNED))
    rows = rows.withColumn("left", F.array_except("all", "pinned"))
    held = F.aggregate("pinned", F.lit(0).cast("long"), lambda a, c: a + c["tokens"])
    rows = rows.withColumn("room", F.greatest(F.lit(0).cast("long"), F.lit(first) - held))
    sections = (("essential", F.col("room"), 4), ("supporting", F.lit(second), 6), ("optional", F.lit(budget - first - second), 8))
    for name, most, n in sections:
        none = F.slice("left", 1, 0)
        start = F.struct(F.lit(0).cast("long").alias("used"), none.alias("took"), none.alias("rest"))
        rows = rows.withColumn("s", F.aggregate("left", start, _greedy(most, n)))
        rows = rows.withColumn(name, F.col("s.took")).withColumn("left", F.col("s.rest")).drop("s")
    tagged = F.concat(F.transform("pinned", _tag("essential")), *[F.transform(name, _tag(name)) for name, _, _ in sections])
    return rows.select("query_id", F.explode(tagged).alias("c")).select("query_id", "c.section", "c.item_id", "c.tokens")


def _greedy(most: Column, n: int):
    """One step of a section: take the candidate if it fits, else pass it on to the next section."""

    def step(a, c):
        size = F.least(c["tokens"], most)
        fits = (F.size(a["took"]) < n) & (a["used"] + size <= most)
        took, rest = F.when(fits, F.array_append(a["took"], c)).otherwise(a["took"]), F.when(fits, a["rest"]).otherwise(F.array_append(a["rest"], c))
        return F.struct((a["used"] + F.when(fits, size).otherwise(0)).cast("long").alias("used"), took.alias("took"), rest.alias("rest"))

    return step


def _tag(name: str):
    return lambda c: F.struct(F.lit(name).alias("section"), c["item_id"].alias("item_id"), c["tokens"].alias("tokens"))


def style_conflicts(rules: DataFrame) -> DataFrame:
    """left, right: rules (rule_id, scope, words, negated) of one scope, of opposite sense, that share half the words of the shorter.

    Pairs meet by a shared word, so rules without one are never compared.
    """
    words = rules.select("rule_id", "scope", "negated", F.size("words").alias("n"), F.explode(F.array_distinct("words")).alias("w"))
    a, b = words.where("negated").alias("a"), words.where("NOT negated").alias("b")
    met = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.w") == F.col("b.w")))
    shared = met.groupBy(F.col("a.rule_id").alias("negated_id"), F.col("b.rule_id").alias("plain_id"), F.least("a.n", "b.n").alias("n")).agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") * 2 >= F.col("n")).select(F.least("negated_id", "plain_id").alias("left_id"), F.greatest("negated_id", "plain_id").alias("right_id"), "shared")

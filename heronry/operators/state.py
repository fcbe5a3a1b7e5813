"""New states of tables: upserts, expiry, policies, proposals and what follows from feedback. A new table takes the old one's place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..functions import text as T


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and of old those whose key new lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def expire(edges: DataFrame, gone: DataFrame, as_of: str) -> DataFrame:
    """edges (src, dst, kind, valid_until) with an end for those of gone items (item_id) that have none yet."""
    g = gone.select(F.col("item_id").alias("src"), F.lit(True).alias("_gone"))
    j = edges.join(g, "src", "left")
    return j.withColumn("valid_until", F.coalesce("valid_until", F.when(F.col("_gone"), F.lit(as_of).cast("timestamp")))).drop("_gone")


def valid(edges: DataFrame, as_of: str) -> DataFrame:
    """Edges whose end is missing, not a time, or later."""
    end = F.try_to_timestamp(F.col("valid_until"))
    return edges.where(end.isNull() | (end > F.lit(as_of).cast("timestamp")))


def path_policy(path: Column, size: Column, most: int = 512 << 10) -> Column:
    """Why a path is left out of ingestion, or null."""
    return F.when(path.rlike(r"(^|/)(node_modules|\.git|dist|build|coverage)/"), "excluded").when(F.lower(path).rlike(r"\.(png|jpe?g|gif|pdf|zip|gz|jar|ico|woff2?)$"), "binary").when(size > most, "too_large")


def namespace(project: Column, item_type: Column, metadata: Column) -> Column:
    """project, kind and agent of an item: the kind follows from its type, the agent is named in its metadata (JSON) or null."""
    kind = F.coalesce(*[F.when(item_type == t, F.lit(k)) for t, k in P.NAMESPACE_KINDS.items()], item_type)
    named = F.btrim(F.coalesce(F.get_json_object(metadata, "$.agentName"), F.get_json_object(metadata, "$.agentTool")))
    return F.struct(project.alias("project"), kind.alias("kind"), F.when(named != "", named).alias("agent"))


def in_namespace(stored: Column, kind: str | None = None, agent: str | None = None, project: str | None = None) -> Column:
    """Whether a namespace has what is asked for; without any, all pass, and no namespace passes anything asked for."""
    wanted = [stored[n] == v for n, v in (("kind", kind), ("agent", agent), ("project", project)) if v]
    return reduce(lambda a, b: a & b, [F.coalesce(w, F.lit(False)) for w in wanted], F.lit(True))


def reuse(atoms: DataFrame, positive: DataFrame) -> DataFrame:
    """atoms (atom_id, reuse, last_reused) after positive feedback (atom_id, ts): one more for each, and the latest time."""
    n = positive.groupBy("atom_id").agg(F.count("*").alias("_n"), F.max("ts").alias("_ts"))
    j = atoms.join(n, "atom_id", "left")
    return j.withColumn("reuse", F.col("reuse") + F.coalesce("_n", F.lit(0))).withColumn("last_reused", F.greatest("last_reused", "_ts")).drop("_n", "_ts")


def proposals(feedback: DataFrame) -> DataFrame:
    """item_id, action, n: what negative feedback (item_id, feedback_type) asks for, once for each item and action."""
    action = F.when(F.col("feedback_type") == "stale", "mark_stale").when(F.col("feedback_type") == "rejected", "review").when(F.col("feedback_type") == "irrelevant", "narrow_labels")
    return feedback.select("item_id", action.alias("action")).where("action IS NOT NULL").groupBy("item_id", "action").agg(F.count("*").alias("n"))


def applied(items: DataFrame, approved: DataFrame) -> DataFrame:
    """item_id, status after approved proposals (item_id, action): archiving wins over review."""
    a = approved.groupBy("item_id").agg(F.max(F.when(F.col("action") == "mark_stale", 2).when(F.col("action") == "review", 1).otherwise(0)).alias("_a"))
    j = items.join(a, "item_id", "left")
    return j.select("item_id", F.when(F.col("_a") == 2, "archived").when(F.col("_a") == 1, "needs_review").otherwise(F.col("status")).alias("status"))


def resolved(queue: DataFrame, action: Column) -> DataFrame:
    """key, value of conflicts (key, local, imported) by the action of each: keep, take, or merge (both, local first)."""
    merged = F.when(F.col("local") == F.col("imported"), F.col("local")).otherwise(F.concat_ws(" | ", "local", "imported"))
    return queue.select("key", F.when(action == "keep", F.col("local")).when(action == "take", F.col("imported")).otherwise(merged).alias("value"))


def retried(fused: DataFrame, shown: DataFrame, limit: int) -> DataFrame:
    """The next best of fused (query_id, item_id, score) when all that was shown (query_id, item_id) is rejected."""
    left = fused.join(shown.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id"))).where(F.col("rank") <= limit)


def rerank(fused: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, item_id, overlap, final, rank: the fused score blended with the share of a query's terms among a text's tokens and with its trust.

    texts: item_id, content, trust. An item without a text overlaps in nothing.
    """
    q = queries.select("query_id", F.array_distinct("terms").alias("terms"))
    j = fused.join(texts.select("item_id", T.tokens(F.col("content"), 1).alias("tokens"), "trust"), "item_id", "left").join(q, "query_id")
    share = F.when(F.size("terms") > 0, F.size(F.array_intersect("terms", F.coalesce("tokens", F.array().cast("array<string>")))) / F.size("terms")).otherwise(0.0)
    trust = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("trust") / 100, F.lit(0.0))))
    blend = P.RERANK["fused"] * F.col("score") + P.RERANK["overlap"] * F.col("overlap") + P.RERANK["trust"] * F.col("own_trust")
    r = j.select("query_id", "item_id", "score", share.alias("overlap"), trust.alias("own_trust"))
    final = r.select("query_id", "item_id", F.round("overlap", 6).alias("overlap"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend)), 6).alias("final"))
    return final.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("final").desc(), "item_id")))


def rewritten(queries: DataFrame, rewrites: DataFrame, exact: int = 48, most: int = 64) -> DataFrame:
    """query_id, exact, terms, confidence: queries (query_id, exact, terms, confidence) with what their rewrite (query_id, exact, terms) adds.

    Exact terms come first and are cut to `exact`; then the rewrite's terms and the query's own, `most` in all. Any rewrite
    raises the confidence, one that adds exact terms more. A query without a rewrite stays as it is.
    """
    j = queries.join(rewrites.select("query_id", F.col("exact").alias("more_exact"), F.col("terms").alias("more")), "query_id", "left")
    fitting = F.filter("more_exact", lambda x: F.length(x) <= 120)
    merged = j.withColumn("merged", F.when(F.col("more").isNotNull(), F.slice(F.array_union("exact", fitting), 1, exact)))
    added = F.size(F.array_except("merged", "exact")) > 0
    return merged.select(
        "query_id", F.coalesce("merged", "exact").alias("exact"), F.when(F.col("merged").isNull(), F.col("terms")).otherwise(F.slice(F.array_distinct(F.concat("merged", "more", "terms")), 1, most)).alias("terms"),
        F.round(F.when(F.col("merged").isNull(), F.col("confidence")).otherwise(F.least(F.lit(0.98), F.col("confidence") + F.when(added, 0.06).otherwise(0.03))), 6).alias("confidence"),
    )


def area_dependencies(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """area, needs, weight, digest: summed confidence of edges (src, dst, confidence) between areas of items (item_id, path)."""
    keyed = paths.select("item_id", T.area_key(F.col("path")).alias("area"))
    a, b = keyed.select(F.col("item_id").alias("src"), "area"), keyed.select(F.col("item_id").alias("dst"), F.col("area").alias("needs"))
    w = edges.join(a, "src").join(b, "dst").where("area <> needs").groupBy("area", "needs").agg(F.round(F.sum("confidence"), 4).alias("weight"))
    return w.withColumn("digest", F.sha2(F.concat_ws(">", "area", "needs"), 256))

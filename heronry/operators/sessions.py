"""State of work sessions from their events, compliance, review queues and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state(events: DataFrame) -> DataFrame:
    """session_id, n_events, n_decisions, first_at, last_at, status from events (session_id, seq, kind)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    done = F.max_by("kind", "seq")
    found = events.groupBy("session_id").agg(F.count("*").alias("n_events"), n("decision").alias("n_decisions"), F.min("seq").alias("first_at"), F.max("seq").alias("last_at"), done.alias("last_kind"))
    return found.withColumn("status", F.when(F.col("last_kind") == "finish", "finished").otherwise("open")).drop("last_kind")


def compliance(bypassed: Column, n_selected: Column, n_missing: Column, fetched: Column) -> Column:
    """Verdict on a session: the first condition that holds."""
    return F.when(bypassed, "bypassed").when(n_selected > 0, "compliant").when(n_missing > 0, "missing_context_recorded").when(fetched, "needs_decision").otherwise("non_compliant")


def review_queue(rows: DataFrame, per_queue: int = 8, most: int = 12) -> DataFrame:
    """The newest of each queue (queue, item_id, status, at), then the most urgent of all."""
    urgency = F.when(F.col("status") == "needs_changes", 0).when(F.col("status").isin("pending", "open"), 1).otherwise(2)
    order = Window.partitionBy("queue").orderBy(F.col("at").desc(), "item_id")
    kept = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_queue).withColumn("urgency", urgency)
    return kept.orderBy("urgency", F.desc("at"), "queue", "item_id").limit(most).select("queue", "item_id", "status", "at", "urgency")


def capped(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Candidates (query_id, rank, category) of each query, at most so many of a category, in order of rank."""
    order = Window.partitionBy("query_id", "category").orderBy("rank")
    most = F.coalesce(*[F.when(F.col("category") == c, F.lit(n)) for c, n in caps.items()], F.lit(1 << 30))
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def covered_signals(signals: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, value, by: which seeds (query_id, item_id, content) hold each signal (query_id, value) of a query."""
    met = signals.join(seeds, "query_id").where(F.contains(F.lower("content"), F.lower("value")))
    return met.groupBy("query_id", "value").agg(F.array_sort(F.collect_set("item_id")).alias("by"))


def worktree(files: DataFrame, most: int) -> DataFrame:
    """query_id, path, reason, score: files (query_id, path, reason, modified) by their best reason, at most a quarter for each reason and `most` in all."""
    score = F.when(F.col("reason") == "prompt_named", 1.0).when(F.col("reason") == "git_changed", 0.85).when(F.col("reason") == "handoff", 0.75).otherwise(0.6)
    s = files.withColumn("score", score)
    best = s.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(F.col("score").desc()))).where("n = 1")
    per = Window.partitionBy("query_id", "reason").orderBy(F.col("modified").desc(), "path")
    kept = best.withColumn("n", F.row_number().over(per)).where(F.col("n") <= -(-most // 4))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("modified").desc(), "path")
    return kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("query_id", "path", "reason", "score")

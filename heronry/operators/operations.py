"""Rollups, review filters, source diffs, clean-up, incidents and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def review_flags(items: DataFrame, summary: DataFrame, references: DataFrame) -> DataFrame:
    """One boolean for each review filter: items (item_id, status, trust, safety, origin), summary of feedback, references (item_id, kind)."""
    refs = references.groupBy("item_id").agg(F.count("*").alias("n_refs"), F.count_if(F.col("kind") != "conversation").alias("n_grounded"))
    j = items.join(summary.select("item_id", "n_stale", "n_rejected", "n_irrelevant"), "item_id", "left").join(refs, "item_id", "left").fillna(0, ["n_stale", "n_rejected", "n_irrelevant", "n_refs", "n_grounded"])
    unsafe, low = F.col("safety").isin("suspicious", "blocked"), F.col("trust") < 50
    stale, rejected, irrelevant = F.col("n_stale") > 0, F.col("n_rejected") > 0, F.col("n_irrelevant") > 0
    odd = unsafe | low | stale | rejected | irrelevant | (F.col("status") != "approved")
    auto = F.col("origin") == "agent_session_finish"
    return j.select(
        "item_id", unsafe.alias("unsafe"), low.alias("low_trust"), stale.alias("stale"), rejected.alias("rejected"), irrelevant.alias("irrelevant"), odd.alias("questionable"),
        (F.col("n_refs") == 0).alias("orphaned"), auto.alias("auto_memory"), (auto & (odd | (F.col("n_grounded") == 0))).alias("risky_auto_memory"),
    )


def sync_plan(ledger: DataFrame, inventory: DataFrame, ignored: Column) -> DataFrame:
    """path, action, prior: added, changed, renamed, deleted, ignored or unchanged of ledger and inventory (path, hash).

    A path that is new with the hash of one that vanished is a renaming; of several, the least vanished path is taken
    once, by the least new path.
    """
    a, b = ledger.select("path", F.col("hash").alias("old")), inventory.select("path", F.col("hash").alias("new"), ignored.alias("ignored"))
    j = a.join(b, "path", "full_outer")
    action = F.when(F.col("ignored"), "ignored").when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    plan = j.withColumn("action", action)
    order = Window.partitionBy("h").orderBy("path")
    gone = plan.where("action = 'deleted'").select(F.col("old").alias("h"), F.col("path")).withColumn("n", F.row_number().over(order)).withColumnRenamed("path", "prior")
    came = plan.where("action = 'added'").select(F.col("new").alias("h"), "path").withColumn("n", F.row_number().over(order))
    moved = came.join(gone, ["h", "n"]).select("path", "prior")
    out = plan.join(moved, "path", "left").join(moved.select(F.col("prior").alias("path"), F.lit(True).alias("left_by")), "path", "left")
    return out.where("left_by IS NULL").select("path", F.when(F.col("prior").isNotNull(), "renamed").otherwise(F.col("action")).alias("action"), "prior")


def error_clusters(errors: DataFrame, limit: int = 20) -> DataFrame:
    """Incidents (event_id, message, severity, category, occurrences, ts) by fingerprint, the most frequent first."""
    keyed = errors.withColumn("fingerprint", T.fingerprint_error(F.col("message")))
    found = keyed.groupBy("fingerprint").agg(F.count("*").alias("n"), F.sum("occurrences").alias("occurrences"), F.max("severity").alias("severity"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return found.orderBy(F.desc("occurrences"), F.desc("severity"), F.desc("last_seen"), "fingerprint").limit(limit)


def rollups(rows: DataFrame, dimensions: tuple[str, ...], total: str) -> DataFrame:
    """dimension, value, n, total over each dimension by itself, in one pass over grouping sets."""
    sets = ", ".join(f"({c})" for c in dimensions)
    named = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in dimensions)
    valued = " ".join(f"WHEN grouping({c}) = 0 THEN CAST({c} AS STRING)" for c in dimensions)
    return rows.sparkSession.sql(f"SELECT CASE {named} END AS dimension, CASE {valued} END AS value, count(*) AS n, sum({total}) AS total FROM {{rows}} GROUP BY GROUPING SETS ({sets})", rows=rows)


def area_model(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """area, label, n_items, n_crossing: items (item_id, path) by area of their path, and undirected edges (src, dst) that leave it."""
    keyed = paths.select("item_id", T.area_key(F.col("path")).alias("area"))
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    a, b = keyed.select(F.col("item_id").alias("u"), F.col("area").alias("au")), keyed.select(F.col("item_id").alias("v"), F.col("area").alias("av"))
    cross = pairs.join(a, "u").join(b, "v").where("au <> av")
    n = cross.select(F.explode(F.array("au", "av")).alias("area")).groupBy("area").agg(F.count("*").alias("n_crossing"))
    items = keyed.groupBy("area").agg(F.count("*").alias("n_items"))
    return items.join(n, "area", "left").select("area", T.area_label(F.col("area")).alias("label"), "n_items", F.coalesce("n_crossing", F.lit(0)).alias("n_crossing"))


def retention(backups: DataFrame, keep: int) -> DataFrame:
    """path, keep of backups (path, created, ok, verified): the newest `keep`, the newest successful one, those that fail verification, and none other.

    What is outside the first `keep` goes whatever its age, so an age limit would add nothing.
    """
    order = (F.col("created").desc(), "path")
    newest = backups.orderBy(*order).limit(max(1, keep)).select("path")  # each task keeps as many, and one picks of those
    good = backups.where("ok").orderBy(*order).limit(1).select("path")
    stays = newest.union(good).distinct().withColumn("stays", F.lit(True))
    rows = backups.join(F.broadcast(stays), "path", "left")  # keep + 1 rows at most
    return rows.select("path", (F.coalesce("stays", F.lit(False)) | ~F.col("verified")).alias("keep"))

"""Measures of retrieval and classification against expected results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import rounded


def hits(expected: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, hit, reciprocal, precision: expected (query_id, item_id), found (query_id, item_id, rank).

    A query that expects nothing counts as hit, with reciprocal rank 0.
    """
    marked = found.join(expected.withColumn("good", F.lit(True)), ["query_id", "item_id"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    return judged(marked, expected.select("query_id").distinct(), k)


def judged(marked: DataFrame, expecting: DataFrame, k: int) -> DataFrame:
    """As hits, of found rows (query_id, rank, good) and the queries (query_id) that expect something."""
    per = marked.groupBy("query_id").agg(F.min(F.when(F.col("good"), F.col("rank"))).alias("first"), F.count_if(F.col("good") & (F.col("rank") <= k)).alias("n_good"), F.count_if(F.col("rank") <= k).alias("n"))
    j = per.where("n > 0").join(expecting.withColumn("some", F.lit(True)), "query_id", "left")
    hit = F.when(F.col("some").isNull(), 1).otherwise(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)))
    return j.select("query_id", hit.alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal"), (F.col("n_good") / F.col("n")).alias("precision"))


def hit_rate(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("n"), rounded(F.avg("hit"), 4).alias("hit_rate"), rounded(F.avg("reciprocal"), 4).alias("mrr"), rounded(F.avg("precision"), 4).alias("precision"))


def confusion(rows: DataFrame, actual: Column, predicted: Column, *by: str) -> DataFrame:
    """Counts, precision, recall and F1 of boolean columns."""
    c = rows.groupBy(*by).agg(F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, "tp", "fp", "fn", "tn", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def nearest_rank(rows: DataFrame, value: str, quantiles: tuple[float, ...], *by: str) -> DataFrame:
    """p50 and the like, not interpolated: the value at place floor(q * n) of each group in order.

    Places come from counts of values, so a group's rows are summed up before they are ordered.
    """
    n = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    to = n.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(value))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = lambda q: F.least(F.floor(q * F.col("n")), F.col("n") - 1)
    return to.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > at(q), F.col(value))).alias(f"p{round(q * 100)}") for q in quantiles], F.max(value).alias("most"))


def calibrate_k(ranks: DataFrame, grid: tuple[int, ...], default: int = 60) -> DataFrame:
    """k, n_hits, best: hits among the first five for each k of the grid over ranks (query_id, item_id, rank, weight, good); ties keep the default, then the least k."""
    ks = ranks.sparkSession.createDataFrame([(k,) for k in grid], "k int")
    s = ranks.crossJoin(F.broadcast(ks)).groupBy("k", "query_id", "item_id").agg(F.sum(F.col("weight") / (F.col("k") + F.col("rank"))).alias("s"), F.max("good").alias("good"))
    top = s.withColumn("place", F.row_number().over(Window.partitionBy("k", "query_id").orderBy(F.round("s", 9).desc(), "item_id"))).where("place <= 5")
    n = top.groupBy("k").agg(F.sum("good").alias("n_hits"))
    order = Window.orderBy(F.desc("n_hits"), (F.col("k") != default).cast("int"), "k")  # one row for each k
    return n.select("k", "n_hits", (F.row_number().over(order) == 1).alias("best"))

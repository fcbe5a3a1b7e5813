"""Listings, windows and readable exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import rounded


def in_order(rows: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows whose key is among ids, with place: its position there."""
    listed = F.array(*[F.lit(i).cast("bigint") for i in ids])
    return rows.withColumn("place", F.array_position(listed, F.col(key).cast("bigint"))).where("place > 0")


def recent(rows: DataFrame, time: str, days: int, as_of: str) -> DataFrame:
    """Rows of the last days before as_of."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return rows.where((F.col(time) >= end - F.make_dt_interval(F.lit(days))) & (F.col(time) < end))


def weak_labels(items: DataFrame) -> DataFrame:
    """item_id, value, confidence of inferred labels below 0.5: items has labels as array of struct(value, source, confidence)."""
    each = items.select("item_id", F.explode("labels").alias("l")).select("item_id", "l.value", "l.source", "l.confidence")
    return each.where("source = 'classifier' AND confidence < 0.5").select("item_id", "value", "confidence")


def graph_lines(items: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, id, line: one JSON object for each item, then for each relation."""
    i = items.select(F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("id"), F.to_json(F.struct("item_id", "item_type", "project", "status")).alias("line"))
    e = edges.select(F.lit("relation").alias("kind"), F.concat_ws("-", "src", "dst", "kind").alias("id"), F.to_json(F.struct("dst", "kind", "src")).alias("line"))
    return i.unionByName(e)


def summaries(items: DataFrame, limit: int = 5) -> DataFrame:
    """project, n, summary: the first items (item_id, item_type, trust) of each project by trust, one to a line.

    The line-up of a project is cut before it is gathered.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("project").orderBy(F.col("trust").desc(), "item_id")
    n = items.groupBy("project").agg(F.count("*").alias("n"))
    top = items.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)
    line = F.concat(F.lit("- ["), "item_type", F.lit("] "), F.col("item_id").cast("string"), F.lit(" (trust "), F.col("trust").cast("string"), F.lit(")"))
    gathered = top.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n").alias("summary"))
    return gathered.join(n, "project").select("project", "n", "summary")


def calibrated_weights(contributions: DataFrame, base: dict[str, float]) -> DataFrame:
    """source, weight: base weights moved by each source's share of the contribution (source, contribution), within 0.7 and 1.4."""
    mean = contributions.agg(F.avg("contribution").alias("mean"))
    w = F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in base.items()], F.lit(1.0))
    moved = w * (0.6 + 0.4 * F.col("contribution") / F.col("mean"))
    return contributions.crossJoin(mean).select("source", rounded(F.least(F.lit(1.4), F.greatest(F.lit(0.7), moved)), 3).alias("weight"))

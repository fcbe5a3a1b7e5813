"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


#: Parts into which the neighbours of a node are dealt, so that those of a hub spread over as many tasks.
PARTS = 64


def _told(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with m, the least v of their u; u and m of every u). A node's least is told to those of its parts that have edges, never to all."""
    dealt = e.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    by_part = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = by_part.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("parts"))  # PARTS at most
    told = least.select("u", "m", F.explode("parts").alias("part"))
    return dealt.join(told, ["u", "part"]).select("u", "v", "m"), least.select("u", "m")


def _large(e: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's least neighbour."""
    both, _ = _told(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of them. e has u > v."""
    tied, least = _told(e)
    return tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether all components are stars around their least node: no node has two lesser ones, or a lesser and a greater one."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of edges (u, v); roots too. Hubs are only ever reduced by min."""
    e = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(e):
        after = cut(_small(_large(e)))
        drop_cut(e)
        e = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

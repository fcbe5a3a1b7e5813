"""Labels widened by what stands above them in trees of terms.

A tree may be of any depth, and a term may stand in it several times; its first place in order counts. Ancestors come from
rounds of one join each, which reach one step further up, so there are as many rounds as the tree has levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut


def placed(trees: dict[str, dict]) -> list[tuple[int, str, str, int | None]]:
    """(place, axis, value, place of the parent) of every term of nested dicts, parents before their children."""
    out = []

    def walk(axis, tree, parent):
        for value, below in tree.items():
            own = len(out)
            out.append((own, axis, value, parent))
            walk(axis, below, own)

    for axis, tree in trees.items():
        walk(axis, tree, None)
    return out


def closure(nodes: DataFrame) -> DataFrame:
    """axis, leaf, ancestor, distance: all that stands above each term of nodes (place, axis, value, parent), terms normalised; cut."""
    own = cut(nodes.select("place", "axis", T.normalize_label(F.col("value")).alias("value"), "parent"))
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("axis", "value").orderBy("place"))).where("n = 1")
    above = own.select(F.col("place").alias("at"), F.col("value").alias("ancestor"), F.col("parent").alias("next"))
    step = cut(first.where("parent IS NOT NULL").select("axis", F.col("value").alias("leaf"), F.col("parent").alias("at"), F.lit(1).alias("distance")).join(above, "at").drop("at"))
    found = step
    while not step.where("next IS NOT NULL").isEmpty():
        step = cut(step.where("next IS NOT NULL").select("axis", "leaf", F.col("next").alias("at"), (F.col("distance") + 1).alias("distance")).join(above, "at").drop("at"))
        found = found.unionByName(step)
    return found.select("axis", "leaf", "ancestor", "distance")


def expanded(labels: DataFrame, above: DataFrame) -> DataFrame:
    """item_id, type, value, weight, source, confidence: labels (item_id, nr, type, value, weight) in order, each followed by its ancestors (above: axis, leaf, ancestor, distance), the nearest first.

    Of what is the same when normalised, the first in that order stays. An ancestor weighs 0.7 of its label, 0.1 less a step, 0.3 at
    least, but never more than the label; a label without a weight counts as 0.75 for that.
    """
    own = labels.select("item_id", "nr", F.lit(0).alias("distance"), "type", "value", "weight", F.lit("label").alias("source"), F.lit(None).cast("double").alias("confidence"), T.normalize_label(F.col("value")).alias("key"))
    w, far = F.coalesce("weight", F.lit(0.75)), F.col("distance") - 1
    met = labels.withColumns({"axis": F.col("type"), "leaf": T.normalize_label(F.col("value"))}).join(above, ["axis", "leaf"])
    up = met.select("item_id", "nr", "distance", "type", F.col("ancestor").alias("value"), F.least(w, F.greatest(F.lit(0.3), w * (0.7 - far * 0.1))).alias("weight"), F.lit("ontology").alias("source"), F.greatest(F.lit(0.4), 0.85 - far * 0.1).alias("confidence"), F.col("ancestor").alias("key"))
    kept = own.unionByName(up).groupBy("item_id", "type", "key").agg(F.min_by(F.struct("value", "weight", "source", "confidence"), F.struct("nr", "distance")).alias("x"))
    return kept.select("item_id", "type", "x.value", F.round("x.weight", 6).alias("weight"), "x.source", F.round("x.confidence", 6).alias("confidence"))

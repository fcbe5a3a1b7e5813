"""Ingestion of items, batch by batch or as a stream that may be killed at any time.

An item goes through a limit of size, redaction and the safety verdict, its item type and labels, the check for duplicates,
chunks and relations. What fails is a row of errors and leaves the others alone. A store is a folder with a part for each
batch and table (items, errors, chunks, relations); the state before a batch is what the parts before it say, the last row
of an address counting. A batch that is run again writes its own parts again from the same state, so a stream that was
killed between two writes ends up as one that was not.

Within a batch, of items of one project with equal words the first is taken; all others are held against the latest of
their project in the store. Of rows with one address the last counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..functions import text as T
from ..operators import chunking, duplicates, graph, ingest, ontology, signals
from ..sources.shared import cut

INPUT = "nr bigint, project string, uri string, item_type string, title string, summary string, content string, fresh_on timestamp, origin string, trig string, taxonomy string, refs array<struct<type:string,uri:string>>"
ITEMS = "item_id string, project string, uri string, item_type string, title string, summary string, content string, fresh_on timestamp, safety string, flagged string, labels array<struct<type:string,value:string,weight:double>>"
TABLES = {
    "items": ITEMS,
    "errors": "nr bigint, project string, uri string, error string, match_id string",
    "chunks": "item_id string, chunk_index int, content string, n_tokens long",
    "relations": "item_id string, kind string, target string, confidence double",
}
#: Bytes of an item's text, and labels that a classification may add to those a user gave.
MOST, AXES = 512 << 10, ("project", "task_type", "domain", "technology", "business_area")


def address() -> F.Column:
    return F.sha2(F.concat_ws("\x00", F.coalesce("project", F.lit("")), "uri"), 256)


def _labels(rows: DataFrame) -> DataFrame:
    """item_id, labels: of the classification of each text, with what stands above them."""
    classified = signals.classify(rows.select("item_id", "project", F.col("content").alias("prompt")))
    own = ingest.classifier_labels(classified, "item_id").where(F.col("type").isin(*AXES)).select("item_id", F.col("n").alias("nr"), "type", "value", "weight")
    above = ontology.closure(rows.sparkSession.createDataFrame(ontology.placed(P.ONTOLOGY), "place int, axis string, value string, parent int"))
    wide = ontology.expanded(own, above)
    return wide.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("type", "value", "weight"))).alias("labels"))


def ingested(rows: DataFrame, known: DataFrame, most: int = MOST) -> dict[str, DataFrame]:
    """The four tables that rows (INPUT) make, given the items that are known (ITEMS); all cut."""
    order = Window.partitionBy("project", "uri").orderBy(F.col("nr").desc())
    own = cut(rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n").withColumn("item_id", address()))
    big = own.where(F.octet_length("content") > most).select("nr", "project", "uri", F.lit("too_large").alias("error"), F.lit(None).cast("string").alias("match_id"))
    fits = own.where(F.coalesce(F.octet_length("content"), F.lit(0)) <= most).withColumn("safety", F.lit(None).cast("string"))
    safe = cut(ingest.sanitized(fits, ("title", "summary", "content")))
    blocked = fits.join(safe.select("item_id"), "item_id", "left_anti").select("nr", "project", "uri", F.lit("blocked").alias("error"), F.lit(None).cast("string").alias("match_id"))
    typed = ingest.refined(safe.withColumnRenamed("refs", "references").withColumn("hint", F.col("item_type"))).drop("hint", "references", "origin", "trig", "taxonomy")
    same = Window.partitionBy("project", F.sha2(T.normalize_text(F.lower(F.coalesce("content", F.lit("")))), 256)).orderBy("nr", "uri")
    typed = cut(typed.withColumn("first_id", F.first("item_id").over(same)))
    again = typed.where("first_id <> item_id").select("nr", "project", "uri", F.lit("duplicate").alias("error"), F.col("first_id").alias("match_id"))
    single = typed.where("first_id = item_id").drop("first_id")
    surface = F.concat_ws("\n", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "summary", "content")])
    listed = duplicates.latest(known.withColumn("status", F.lit("approved"))).select("item_id", "project", "n", "content", surface.alias("surface"))
    both = single.select("item_id", "project", F.lit(None).cast("int").alias("n"), "content", surface.alias("surface")).unionByName(listed)
    keyed = cut(duplicates.surfaces(both.withColumn("key", F.concat(F.when(F.col("n").isNull(), "i").otherwise("l"), "item_id")), "surface"))
    judged = cut(duplicates.assess(keyed.where("n IS NULL"), keyed.where("n IS NOT NULL")))
    refused = single.join(judged.where("decision IN ('reject', 'block')").select("item_id", "match_id"), "item_id").select("nr", "project", "uri", F.lit("duplicate").alias("error"), "match_id")
    taken = single.join(judged.where("decision NOT IN ('reject', 'block')").select("item_id", F.when(F.col("decision") == "flag", F.col("match_id")).alias("flagged")), "item_id")
    labels = _labels(taken)
    items = cut(taken.join(labels, "item_id", "left").select("item_id", "project", "uri", "item_type", "title", "summary", "content", "fresh_on", "safety", "flagged", F.coalesce("labels", F.array().cast("array<struct<type:string,value:string,weight:double>>")).alias("labels")))
    chunks = chunking.chunk_split(items.select(F.col("item_id").alias("doc_id"), "content").na.fill("", ["content"]).withColumnRenamed("content", "text")).withColumnRenamed("doc_id", "item_id")
    named = signals.classify(items.select("item_id", F.col("content").alias("prompt"))).withColumn("technology", F.col("technologies"))
    yes = F.lit(True)
    relations = graph.inferred([("mentions_file", F.col("files"), yes, 0.9), ("mentions_symbol", F.col("symbols"), yes, 0.85), ("resolves_error", F.col("errors"), yes, 0.85)], named)
    errors = reduce(DataFrame.unionByName, [big, blocked, again, refused])
    return {"items": items, "errors": cut(errors), "chunks": cut(chunks.select("item_id", "chunk_index", "content", "n_tokens")), "relations": cut(relations)}


def _parts(spark: SparkSession, store: str, table: str, before: int | None) -> DataFrame:
    """Rows of all parts of a table with the number of their batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{table}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], TABLES[table]).withColumn("batch", F.lit(0))
    rows = spark.read.schema(f"{TABLES[table]}, batch int").parquet(f"{store}/{table}")
    return rows if before is None else rows.where(F.col("batch") < before)


def stored(spark: SparkSession, store: str, table: str, before: int | None = None) -> DataFrame:
    """A table of the store: items by the last batch that took them, chunks and relations of that batch, and all errors."""
    rows = _parts(spark, store, table, before)
    if table == "errors":
        return rows.drop("batch")
    last = _parts(spark, store, "items", before).groupBy("item_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["item_id", "batch"], "left_semi").drop("batch")


def take(store: str, most: int = MOST, after: Callable[[int, str], None] = lambda batch, table: None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: takes a batch of rows (INPUT) into the store. after is told of every part that is written."""

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        made = ingested(rows, stored(spark, store, "items", before=batch), most)
        for table in ("chunks", "relations", "errors", "items"):
            made[table].write.mode("overwrite").parquet(f"{store}/{table}/batch={batch}")
            after(batch, table)

    return run


def start(rows: DataFrame, store: str, checkpoint: str, **parameters):
    """A streaming query that takes rows (INPUT) into the store."""
    return rows.writeStream.foreachBatch(take(store, **parameters)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

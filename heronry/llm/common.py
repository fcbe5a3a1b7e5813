"""Helpers that the text operators share: tables, cut lineage, folds, small batches, bounded samples."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java or Python character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without the setting gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = os.path.join(tempfile.gettempdir(), f"heronry-{os.getpid()}")
    os.makedirs(found, exist_ok=True)
    return f"file://{found}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heronry-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by cut() once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, name: str) -> str:
    """name, or with underscores added what no column of df is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_crc(column: str, mod: int) -> Column:
    """crc32 of the decimal id, modulo mod; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def small(batches, rows: int = 256):
    """The batches in slices of so many rows, so that few texts at a time are Python objects. At the end Arrow's free memory goes back: the worker lives on for other tasks."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    batch = None
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounded_sample(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """About `most` rows of each value of column kind, chosen by a hash of doc_id: the bound on what a model is fitted to.

    A count for each value gives the fraction to keep; a rank by the same hash cuts what exceeds the bound.
    """
    from pyspark.sql import Window

    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    counts = {r[kind]: r["n"] for r in rows.groupBy(kind).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    share = F.coalesce(*[F.when(F.col(kind) == v, F.lit(min(1.0, 1.5 * most / n))) for v, n in sorted(counts.items())])
    ranked = rows.withColumn("_at", at).where(F.col("_at") <= share)
    return ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(kind).orderBy("_at", "doc_id"))).where(F.col("_rank") <= most).drop("_at", "_rank")

"""Files as tables or as streams: trees, diffs, logs of commits, incidents.

Every reader takes stream=True to read the same rows as they arrive: Spark's file source keeps what it has read in the
checkpoint, so a restarted stream reads each file once. What can't be parsed is a row of its own, marked as malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"
#: Folders and names that are left out of an inventory.
EXCLUDED, BINARY, MOST = r"(^|/)(node_modules|\.git|dist|build|coverage)/", r"\.(png|jpe?g|gif|pdf|zip|gz|jar|ico|woff2?)$", 512 << 10
#: A record, which begins the text or follows a zero byte.
_RECORD = r"(?<![^\x00])(?:R[^\x00]*\x00[^\x00]*\x00[^\x00]*\x00|C[^\x00]*\x00[^\x00]*\x00[^\x00]*\x00|[^RC\x00][^\x00]*\x00[^\x00]*\x00)"


def _read(spark: SparkSession, kind: str, schema: str, path: str, stream: bool, **options) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if stream and "per_trigger" in options:
        reader = reader.option("maxFilesPerTrigger", options["per_trigger"])
    for name, value in options.items():
        if name != "per_trigger":
            reader = reader.option(name, value)
    return reader.format(kind).schema(schema).option("recursiveFileLookup", "true").load(path)


def inventory(spark: SparkSession, root: str, stream: bool = False, **options) -> DataFrame:
    """path below root, size, modified, hash, skip of every file; skip says why a file is left out, and then it is not hashed."""
    rows = _read(spark, "binaryFile", _BINARY, root, stream, **options)
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    path = F.element_at(F.split("path", F.concat(F.lit(r"\Q"), base, F.lit(r"\E"))), -1)
    skip = F.when(F.col("own").rlike(EXCLUDED), "excluded").when(F.lower("own").rlike(BINARY), "binary").when(F.col("length") > MOST, "too_large")
    return rows.withColumn("own", path).withColumn("skip", skip).select(F.col("own").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.when(F.col("skip").isNull(), F.sha2("content", 256)).alias("hash"), "skip")


def tracked(content: Column) -> Column:
    """Paths of a listing of tracked files, each ended by a zero byte."""
    return F.filter(F.split(content, "\\x00"), lambda x: x != "")


def diff_records(content: Column) -> Column:
    """path, status, prior, similarity, malformed of the records of a diff: a status and its paths, each ended by a zero byte.

    A renaming has a similarity (100 if it tells none) and both paths; a copy is a file added; any other status than A, D, R and C
    is a modification. What is left over, such as a record cut short, is one malformed record with the rest as its path.
    """
    text = F.concat(F.array_join(tracked(content), "\x00"), F.lit("\x00"))
    hits = F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0))

    def one(r):
        part = lambda k: F.get(F.split(r, "\\x00"), F.lit(k))
        kind = F.substring(part(0), 1, 1)
        two = kind.isin("R", "C")
        status = F.when(kind.isin("A", "C"), "added").when(kind == "D", "deleted").when(kind == "R", "renamed").otherwise("modified")
        told = F.regexp_extract(part(0), r"^R(\d{1,9})$", 1)
        similar = F.when(kind == "R", F.when((told == "") | (told.rlike("^0*$")), 100).otherwise(F.nullif(told, F.lit("")).cast("int")))
        return F.struct(F.when(two, part(2)).otherwise(part(1)).alias("path"), status.alias("status"), F.when(kind == "R", part(1)).alias("prior"), similar.alias("similarity"), F.lit(False).alias("malformed"))

    rest = F.regexp_replace(F.regexp_replace(text, _RECORD, ""), "\\x00", " ")
    none = F.lit(None)
    broken = F.struct(F.trim(rest).alias("path"), none.cast("string").alias("status"), none.cast("string").alias("prior"), none.cast("int").alias("similarity"), F.lit(True).alias("malformed"))
    return F.concat(F.transform(hits, one), F.filter(F.array(broken), lambda x: x["path"] != ""))


def diffs(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """file and the records of the diffs below path, one file each."""
    rows = _read(spark, "binaryFile", _BINARY, path, stream, **options)
    return rows.select(F.col("path").alias("file"), F.explode(diff_records(F.col("content").cast("string"))).alias("r")).select("file", "r.*")


def commits(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """commit_id, path of logs below path: blocks that begin with dashes and a hash, one path to a line. Logs are split at the dashes, so a long one is read by many tasks."""
    rows = _read(spark, "text", "value string", path, stream, lineSep="----", **options)
    id_ = F.regexp_extract("value", r"\A\s*([0-9a-f]{7,40})", 1)
    lines = rows.select(id_.alias("commit_id"), F.explode(F.array_distinct(F.transform(F.split("value", "\n"), lambda x: F.trim(x)))).alias("path"))
    return lines.where("commit_id <> '' AND path <> '' AND path <> commit_id")


def incidents(spark: SparkSession, path: str, stream: bool = False, lines: bool = False, **options) -> DataFrame:
    """Incidents in JSON, a file each or (lines) a line each, with malformed: no JSON, or none with an id."""
    schema = "id string, category string, severity int, message string, occurrences bigint, ts timestamp, _corrupt string"
    rows = _read(spark, "json", schema, path, stream, multiLine=str(not lines).lower(), mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", **options)
    bad = F.col("_corrupt").isNotNull() | F.col("id").isNull()
    return rows.withColumn("malformed", bad).drop("_corrupt")

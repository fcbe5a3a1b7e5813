"""Export and import of facts, items and edges: Markdown with front matter, JSON lines, manifests, backups.

Everything is written and read by Spark's own writers and readers, so a path may lie in any store that Spark knows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a backup, in order.
SCHEMA_VERSION = 2


def to_front_matter(fields: tuple[str, ...], body: str) -> Column:
    """A Markdown document: the fields as JSON values between dashes, then the body."""
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.to_json(F.struct(F.col(f).alias("v"))), F.lit("{}"))) for f in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce(F.col(body), F.lit("")))


def from_front_matter(document: Column, fields: dict[str, str]) -> list[Column]:
    """Columns of the given types, and body, of such a document; a missing field is null, and so is all of a malformed one."""
    head = F.regexp_extract(document, r"(?s)\A---\n(.*?)\n---\n", 1)
    found = [F.from_json(F.nullif(F.regexp_extract(head, rf"(?m)^{name}: (.*)$", 1), F.lit("")), f"v {kind}")["v"].alias(name) for name, kind in fields.items()]
    return [*found, F.when(document.rlike(r"(?s)\A---\n.*?\n---\n"), F.regexp_replace(document, r"(?s)\A---\n.*?\n---\n", "")).alias("body")]


def edge_lines(edges: DataFrame) -> DataFrame:
    """value: one JSON object for each edge, in order, with keys in order."""
    return edges.orderBy("src", "dst", "kind").select(F.to_json(F.struct("confidence", "dst", "kind", "src")).alias("value"))


def parse_edges(lines: DataFrame) -> DataFrame:
    e = F.from_json("value", "src bigint, dst bigint, kind string, confidence double")
    return lines.select(e.alias("e")).where("e.src IS NOT NULL AND e.dst IS NOT NULL").select("e.*")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n, digest of each table: the digest is the sum of the rows' hashes, so it holds in any order."""
    one = lambda name, df: df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("name"), "n", "digest")
    return reduce(DataFrame.unionByName, [one(n, t) for n, t in sorted(tables.items())])


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each table, then the manifest; a folder without a manifest is not a backup."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")
    manifest(tables).withColumn("schema_version", F.lit(SCHEMA_VERSION)).coalesce(1).write.json(f"{path}/manifest")


def restore(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).json(f"{path}/{name}") for name, s in schemas.items()}


def verify(spark: SparkSession, path: str, schemas: dict[str, str]) -> DataFrame:
    """name, n, ok of every table of the manifest."""
    told = spark.read.schema("name string, n long, digest string").json(f"{path}/manifest")
    now = manifest(restore(spark, path, schemas)).withColumnsRenamed({"n": "n_now", "digest": "digest_now"})
    return told.join(now, "name", "left").select("name", "n", ((F.col("n") == F.col("n_now")) & (F.col("digest") == F.col("digest_now"))).alias("ok"))


def files(spark: SparkSession, path: str, most: int = 512 << 10) -> DataFrame:
    """path, size, modified, hash, skip of all files below path; skip says why a file is left out of ingestion."""
    name = F.col("path")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    skip = F.when(name.rlike(r"/(node_modules|\.git|dist|build|coverage)/"), "excluded").when(F.lower(name).rlike(r"\.(png|jpe?g|gif|pdf|zip|gz|jar|ico|woff2?)$"), "binary").when(F.col("length") > most, "too_large")
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.when(skip.isNull(), F.sha2("content", 256)).alias("hash"), skip.alias("skip"))


def commits(log: DataFrame) -> DataFrame:
    """commit_id, path of a log read as whole text (value): blocks that begin with dashes and a hash, one path to a line."""
    block = F.explode(F.split("value", r"(?m)^----"))
    lines = log.select(block.alias("b")).select(F.regexp_extract("b", r"\A\s*([0-9a-f]{7,40})", 1).alias("commit_id"), F.explode(F.split("b", "\n")).alias("path"))
    return lines.select("commit_id", F.trim("path").alias("path")).where("commit_id <> '' AND path <> '' AND path <> commit_id").distinct()


def incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incident files (JSON), malformed ones dropped."""
    return spark.read.schema("id string, category string, severity int, message string, occurrences bigint, ts timestamp").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)

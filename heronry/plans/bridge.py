"""Items, prompts, facts, edges and events made of the driver's tables, as DataFrames and as SQL for DuckDB.

Both sides build the same rows: TABLES gives a DataFrame by name, CTE the SQL of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31"
VERBS = ("Fix", "Implement", "Refactor", "Review", "Plan", "Explore", "Test", "Summarize")
ITEM_TYPES = ("memory", "rule", "spec", "bugfix", "workflow", "wiki", "code_ref", "conversation")
KINDS = ("related_to", "depends_on", "refines", "co_changes_with", "supersedes")
TIERS = ("draft", "verified", "canonical")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, at):
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def prompts(spark, d):
    p = read(spark, d, "part")
    text = F.concat(
        pick(VERBS, F.col("p_partkey") % 8), F.lit(" "), "p_type", F.lit(" handling of `"), F.regexp_replace("p_brand", "#", "_"), F.lit("Service` in src/"), F.element_at(F.split("p_name", " "), 1), F.lit("/"),
        F.regexp_replace("p_name", " ", "-"), F.lit(".ts; it raises ERR-"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 4, "0"), F.lit(" with redis and "),
        F.when(F.col("p_size") % 2 == 0, "must use the current path").otherwise("never use the legacy path"),
    )
    return p.select(F.col("p_partkey").alias("query_id"), text.alias("prompt"), "p_size", "p_brand", "p_type", "p_name")


def items(spark, d):
    k = F.col("doc_id")
    return read(spark, d, "documents").select(
        k.alias("item_id"), F.col("source").alias("project"), pick(ITEM_TYPES, k % 8).alias("item_type"), (30 + k * 7 % 70).cast("int").alias("trust"),
        F.when(k % 17 == 0, "archived").otherwise("approved").alias("status"), F.date_sub(F.lit(AS_OF).cast("date"), (k * 13 % 900).cast("int")).alias("fresh_on"), "lang", F.col("text").alias("content"),
    )


def feedback(spark, d):
    n = read(spark, d, "documents").agg(F.count("*").alias("n"))
    kind = F.when(F.col("event_type") == "purchase", "selected").when(F.col("event_type") == "click", "selected_but_noisy").when(F.col("event_type") == "view", "irrelevant").when(F.col("event_type") == "error", "rejected").otherwise("stale")
    return read(spark, d, "events").crossJoin(F.broadcast(n)).select("event_id", (F.col("event_id") % F.col("n")).alias("item_id"), kind.alias("feedback_type"), "ts", "user_id", "value", "props")


def atoms(spark, d):
    p = read(spark, d, "part")
    used = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("reuse"), F.max("l_shipdate").alias("last_reused"))
    found = p.join(used, F.col("p_partkey") == F.col("l_partkey"), "left")
    return found.select(
        F.col("p_partkey").alias("atom_id"), pick(TIERS, F.col("p_size") % 3).alias("tier"), F.coalesce("reuse", F.lit(0)).alias("reuse"), "last_reused", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("claim"),
        F.array(F.lower("p_brand")).alias("symbols"), F.split(F.lower("p_type"), " ").alias("tags"), F.split("p_name", " ").alias("words"), F.when(F.col("p_partkey") % 19 == 0, "archived").otherwise("active").alias("status"), "p_size",
    )


def edges(spark, d):
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), pick(KINDS, F.col("l_linenumber") % 5).alias("kind"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))
    return e.where("src <> dst").groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))


def commits(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("src/s"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/f"), F.col("l_suppkey").cast("string"), F.lit(".ts")).alias("path")).distinct()


CTE = {
    "prompts": f"""prompts AS (SELECT p_partkey AS query_id, {sql_list(VERBS)}[(p_partkey % 8) + 1] || ' ' || p_type || ' handling of `' || replace(p_brand, '#', '_') || 'Service` in src/' || split_part(p_name, ' ', 1) || '/' || replace(p_name, ' ', '-')
 || '.ts; it raises ERR-' || lpad((p_partkey % 1000)::VARCHAR, 4, '0') || ' with redis and ' || CASE WHEN p_size % 2 = 0 THEN 'must use the current path' ELSE 'never use the legacy path' END AS prompt, p_size, p_brand, p_type, p_name FROM part)""",
    "items": f"""items AS (SELECT doc_id AS item_id, source AS project, {sql_list(ITEM_TYPES)}[(doc_id % 8) + 1] AS item_type, (30 + doc_id * 7 % 70)::INT AS trust, CASE WHEN doc_id % 17 = 0 THEN 'archived' ELSE 'approved' END AS status,
 (DATE '{AS_OF}' - (doc_id * 13 % 900)::INT)::DATE AS fresh_on, lang, text AS content FROM documents)""",
    "feedback": """feedback AS (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS item_id, CASE event_type WHEN 'purchase' THEN 'selected' WHEN 'click' THEN 'selected_but_noisy' WHEN 'view' THEN 'irrelevant' WHEN 'error' THEN 'rejected' ELSE 'stale' END AS feedback_type,
 ts, user_id, value, props FROM events)""",
    "atoms": f"""atoms AS (SELECT p_partkey AS atom_id, {sql_list(TIERS)}[(p_size % 3) + 1] AS tier, coalesce(reuse, 0) AS reuse, last_reused, p_name || ' ' || p_type || ' ' || p_brand AS claim, [lower(p_brand)] AS symbols, string_split(lower(p_type), ' ') AS tags,
 string_split(p_name, ' ') AS words, CASE WHEN p_partkey % 19 = 0 THEN 'archived' ELSE 'active' END AS status, p_size
 FROM part LEFT JOIN (SELECT l_partkey, count(*) AS reuse, max(l_shipdate) AS last_reused FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)""",
    "edges": f"""edges AS (SELECT l_partkey AS src, l_suppkey AS dst, {sql_list(KINDS)}[(l_linenumber % 5) + 1] AS kind, max(round(1 - l_discount, 2)) AS confidence FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2, 3)""",
    "commits": """commits AS (SELECT DISTINCT l_orderkey AS commit_id, 'src/s' || (l_suppkey % 7) || '/f' || l_suppkey || '.ts' AS path FROM lineitem)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)

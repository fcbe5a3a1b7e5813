"""A knowledge base of the parts' texts: items with labels, as DataFrames and as SQL. Every 100th item's text is also a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import policy as P
from ..operators import ingest, signals
from .bridge import AS_OF, CTE, ITEM_TYPES, pick, prompts, sql_list
from .text_queries import _TASK_SQL, errors_sql, symbols_sql

TYPES = ("files", "symbols", "errors", "technologies", "areas")


def kb(spark, d):
    """Items made of the parts, dealt out by id first: the file is small, what is done with each text is not."""
    k = F.col("query_id")
    return prompts(spark, d).repartition("query_id").select(
        k.alias("item_id"), F.concat(F.lit("p"), (F.col("p_size") % 5).cast("string")).alias("project"), pick(ITEM_TYPES, k % 8).alias("item_type"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.col("prompt").alias("content"),
        F.when(k % 17 == 0, "archived").otherwise("approved").alias("status"), (30 + k * 7 % 70).cast("int").alias("trust"), F.date_sub(F.lit(AS_OF).cast("date"), (k * 13 % 900).cast("int")).alias("fresh_on"),
        F.when(k % 41 == 0, "legacy_archived").when(k % 43 == 0, "legacy_replaced").alias("legacy"), F.when(k % 23 == 0, "suspicious").when(k % 29 != 0, "safe").alias("safety"),
    )


def classified(spark, d, which="TRUE"):
    """kb, or which rows of it, with task, signals, domain and confidence of the content. Equal texts are classified once."""
    rows = kb(spark, d).where(which)
    found = signals.classify(rows.select(F.col("content").alias("prompt")).distinct())
    return rows.join(found, F.col("content").eqNullSafe(F.col("prompt")))


def own_labels(spark, d):
    """Labels that users gave: a domain for every fourth item, a technology for every third."""
    i = kb(spark, d).select("item_id")
    k = F.col("item_id")
    a = i.where(k % 4 == 0).select("item_id", F.lit("domain").alias("type"), F.concat(F.lit("area"), (k % 3).cast("string")).alias("value"), F.lit(0.9).alias("weight"))
    return a.unionByName(i.where(k % 3 == 0).select("item_id", F.lit("technology").alias("type"), F.lit("Redis").alias("value"), F.lit(0.5).alias("weight")))


def labels(spark, d):
    return ingest.enriched_labels(classified(spark, d), own_labels(spark, d), "item_id")


def queries(spark, d):
    """Every 100th item's text as a query, with intent, the project it is asked for (for two of three) and strict noise tolerance (for half)."""
    k = F.col("item_id")
    q = signals.intent(classified(spark, d, "item_id % 100 = 0"))
    return q.select(
        k.alias("query_id"), "prompt", "task", *TYPES, "domain", F.col("confidence").alias("classified"), "mode", "required", F.when(k % 300 != 0, F.col("project")).alias("wanted_project"), (k % 200 == 0).alias("strict"),
    )


def _found(pattern: str) -> str:
    return f"list_distinct(regexp_extract_all(content, '{pattern}'))"


_TECH = "list_filter([" + ", ".join("CASE WHEN regexp_matches(lower(content), '{}') THEN '{}' END".format(P.TERM_PATTERNS.get(t, rf"\b{t}\b"), t) for t in P.TECHNOLOGIES) + "], lambda x: x IS NOT NULL)"
_AREAS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(content), '{t}') THEN '{t}' END" for t in P.BUSINESS_AREAS) + "], lambda x: x IS NOT NULL)"
KB = (
    CTE["prompts"] + f""",
kb AS (SELECT query_id AS item_id, 'p' || p_size % 5 AS project, {sql_list(ITEM_TYPES)}[(query_id % 8) + 1] AS item_type, p_name AS title, p_type AS summary, prompt AS content, CASE WHEN query_id % 17 = 0 THEN 'archived' ELSE 'approved' END AS status,
 (30 + query_id * 7 % 70)::INT AS trust, (DATE '{AS_OF}' - (query_id * 13 % 900)::INT)::DATE AS fresh_on, CASE WHEN query_id % 41 = 0 THEN 'legacy_archived' WHEN query_id % 43 = 0 THEN 'legacy_replaced' END AS legacy,
 CASE WHEN query_id % 23 = 0 THEN 'suspicious' WHEN query_id % 29 <> 0 THEN 'safe' END AS safety FROM prompts),
k1 AS (SELECT *, {_TASK_SQL.replace("prompt", "content")} AS task, {_found(P.FILE_PATTERN)} AS files, {symbols_sql("content")} AS symbols, {errors_sql("content")} AS errors, {_TECH} AS technologies, {_AREAS} AS areas FROM kb),
kc AS (SELECT *, nullif(regexp_extract(lower(files[1]), '^src/([a-z][\\w-]+)/', 1), '') AS domain,
 least(0.96::DOUBLE, 0.2::DOUBLE + 0.1::DOUBLE * ((task <> 'unknown')::INT + (len(files) > 0)::INT + (len(symbols) > 0)::INT + (len(errors) > 0)::INT + (len(technologies) > 0)::INT + (len(areas) > 0)::INT)) AS confidence FROM k1)"""
)
_EACH = {"project": "[project]", "task_type": "list_filter([task], lambda x: x <> 'unknown')", "domain": "list_filter([domain], lambda x: x IS NOT NULL)", "file": "files", "symbol": "symbols", "error": "errors", "technology": "technologies", "business_area": "areas"}
#: Labels that a classification gives, with the confidence of their type.
GIVEN = "given AS (" + " UNION ALL ".join(f"SELECT item_id, '{t}' AS type, unnest({_EACH[t]}) AS value, {w}::DOUBLE AS weight, {c}::DOUBLE AS confidence, round(least(1, greatest(0, 0.55::DOUBLE + 0.4::DOUBLE * confidence)), 6) AS sure FROM kc" for t, w, c in P.LABELS) + ")"
LABELS = (
    GIVEN + """,
own AS (SELECT item_id, 'domain' AS type, 'area' || item_id % 3 AS value, 0.9::DOUBLE AS weight FROM kb WHERE item_id % 4 = 0 UNION ALL SELECT item_id, 'technology', 'Redis', 0.5::DOUBLE FROM kb WHERE item_id % 3 = 0),
every AS (SELECT item_id, type, value, weight, 0.95::DOUBLE AS confidence, 'prompt' AS source, 1 AS first FROM own UNION ALL
 SELECT item_id, type, value, weight, sure, 'classifier', 0 FROM given WHERE type <> 'domain' OR item_id NOT IN (SELECT item_id FROM own WHERE type = 'domain')),
kl AS (SELECT item_id, type, arg_max(value, (weight, first)) AS value, max(weight) AS weight, max(confidence) AS confidence, arg_max(source, (weight, first)) AS source FROM every GROUP BY item_id, type, lower(value))"""
)
_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_LOW = "lower(content)"
REQUIRED = (
    "CASE WHEN continuation THEN ['handoff', 'session_history', 'workflow'] ELSE [] END || CASE task " + " ".join(f"WHEN '{t}' THEN {_LIST(v)}" for t, v in P.EVIDENCE.items())
    + f" ELSE ['docs'] END || CASE WHEN len(files) + len(symbols) > 0 THEN ['code_reference'] ELSE [] END || CASE WHEN len(errors) > 0 THEN ['bugfix', 'incident_lesson'] ELSE [] END || CASE WHEN regexp_matches({_LOW}, '{P.MEMORY_WORDS}') THEN ['reflection_memory'] ELSE [] END"
)
_BY = lambda values: "CASE task " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in values.items()) + " ELSE 'unknown' END"
STAGE = f"CASE WHEN continuation THEN 'continuation' ELSE {_BY(P.STAGES)} END"
MODE = "CASE " + " ".join(f"WHEN regexp_matches({_LOW}, '{p}') THEN '{m}'" for m, p in P.MODE_PATTERNS) + f" WHEN continuation THEN 'implementation' ELSE {_BY(P.MODES)} END"
QUERIES = f"""cq AS (SELECT item_id AS query_id, content AS prompt, task, files, symbols, errors, technologies, areas, domain, confidence AS classified, {MODE} AS mode, list_distinct({REQUIRED}) AS required,
 CASE WHEN item_id % 300 <> 0 THEN project END AS wanted_project, item_id % 200 = 0 AS strict FROM (SELECT *, regexp_matches({_LOW}, '{P.CONTINUATION_PATTERN}') AS continuation FROM kc) WHERE item_id % 100 = 0)"""

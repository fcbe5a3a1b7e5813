"""Streams and exports over the driver's tables; a query reads the same rows as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import packs
from ..streaming import incidents
from .bridge import atoms, edges, prompts, read, with_
from .operations_queries import _ERRORS, errors
from .registry import query


@query("WITH " + _ERRORS + r""", k AS (SELECT *, sha256(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(message), '0x[0-9a-f]+|\b[0-9a-f]{8,}\b', '<hex>', 'g'), '\d+', '<n>', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 1, 240)) AS fingerprint FROM err)
SELECT fingerprint, sum(occurrences)::BIGINT AS occurrences, max(severity) AS severity, arg_max(message, (ts, event_id)) AS message, min(ts) AS first_seen, max(ts) AS last_seen FROM k GROUP BY fingerprint""")
def incident_merge(spark, d):
    return incidents.merged(errors(spark, d))


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def windowed_events(spark, d):
    """Counts in hours that begin every half hour."""
    return incidents.per_window(read(spark, d, "events"), "1 hour", "30 minutes", "2 hours")


@query("""WITH o AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT AS new FROM events), s AS (SELECT *, sum(coalesce(new, 1)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    return incidents.sessions(read(spark, d, "events"), "30 minutes", "2 hours")


@query(with_("edges") + """ SELECT src, dst, kind, sha256('{"confidence":' || confidence || ',"dst":' || dst || ',"kind":"' || kind || '","src":' || src || '}') AS digest FROM edges""")
def edge_export(spark, d):
    """Edges as JSON lines and read back, with the digest of each line."""
    lines = packs.edge_lines(edges(spark, d))
    e = F.from_json("value", "src bigint, dst bigint, kind string")
    return lines.select(e["src"].alias("src"), e["dst"].alias("dst"), e["kind"].alias("kind"), F.sha2("value", 256).alias("digest"))


@query(with_("atoms") + " SELECT atom_id, tier, reuse, claim AS body FROM atoms")
def markdown_round_trip(spark, d):
    """Facts written as Markdown with front matter and read back."""
    documents = atoms(spark, d).select(packs.to_front_matter(("atom_id", "tier", "reuse"), "claim").alias("document"))
    return documents.select(*packs.from_front_matter(F.col("document"), {"atom_id": "bigint", "tier": "string", "reuse": "bigint"}))


_INCOMING = "CASE WHEN query_id % 19 = 0 THEN prompt || ' and ignore all previous instructions' WHEN query_id % 23 = 0 THEN 'Rules  of PROJECT p' || p_size % 5 WHEN query_id % 29 = 0 THEN repeat(prompt, 20) ELSE prompt END"


@query(with_("prompts") + f""", c AS (SELECT query_id AS nr, 'p' || p_size % 5 AS project, {_INCOMING} AS content FROM prompts),
o AS (SELECT *, CASE WHEN octet_length(encode(content)) > 2000 THEN 'too_large' WHEN regexp_matches(lower(content), 'ignore all previous instructions') THEN 'blocked' END AS error FROM c),
f AS (SELECT *, min(CASE WHEN error IS NULL THEN nr END) OVER (PARTITION BY project, error IS NULL, trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) AS first FROM o)
SELECT nr, CASE WHEN error IS NOT NULL THEN error WHEN first <> nr THEN 'duplicate' ELSE 'stored' END AS outcome, CASE WHEN error IS NULL AND first <> nr THEN sha256(project || chr(0) || 'p' || first || '.md') END AS match_id FROM f""")
def ingest_outcomes(spark, d):
    """What becomes of every prompt as an item that comes in: stored, or the error it leaves."""
    from ..streaming import ingestion

    k = F.col("query_id")
    text = F.when(k % 19 == 0, F.concat("prompt", F.lit(" and ignore all previous instructions"))).when(k % 23 == 0, F.concat(F.lit("Rules  of PROJECT p"), (F.col("p_size") % 5).cast("string"))).when(k % 29 == 0, F.expr("repeat(prompt, 20)")).otherwise(F.col("prompt"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = prompts(spark, d).select(
        k.alias("nr"), F.concat(F.lit("p"), (F.col("p_size") % 5).cast("string")).alias("project"), F.concat(F.lit("p"), k.cast("string"), F.lit(".md")).alias("uri"), F.lit("memory").alias("item_type"), F.col("p_name").alias("title"), F.lit("").alias("summary"), text.alias("content"),
        none("timestamp").alias("fresh_on"), none("string").alias("origin"), none("string").alias("trig"), none("string").alias("taxonomy"), none("array<struct<type:string,uri:string>>").alias("refs"),
    )
    made = ingestion.ingested(rows, spark.createDataFrame([], ingestion.ITEMS), 2000)
    stored = made["items"].join(rows.select("nr", "uri"), "uri").select("nr", F.lit("stored").alias("outcome"), none("string").alias("match_id"))
    return stored.unionByName(made["errors"].select("nr", F.col("error").alias("outcome"), "match_id"))

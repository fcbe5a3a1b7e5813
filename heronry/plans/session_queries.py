"""Sessions, review queues, evidence and chunks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from ..operators import sessions as S
from .bridge import items, prompts, read, with_
from .ranking_queries import BOTH, FUSED, plain
from .registry import query
from .search_queries import vectors

_EVENTS = "ev AS (SELECT conv_id AS session_id, turn AS seq, CASE WHEN length(text) % 7 = 0 THEN 'finish' WHEN role = 'assistant' THEN 'decision' ELSE 'note' END AS kind, text FROM conversations)"


def events(spark, d):
    kind = F.when(F.length("text") % 7 == 0, "finish").when(F.col("role") == "assistant", "decision").otherwise("note")
    return read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), kind.alias("kind"), "text")


@query("WITH " + _EVENTS + " SELECT session_id, count(*) AS n_events, count(*) FILTER (kind = 'decision') AS n_decisions, min(seq) AS first_at, max(seq) AS last_at, CASE WHEN arg_max(kind, seq) = 'finish' THEN 'finished' ELSE 'open' END AS status FROM ev GROUP BY 1")
def session_state(spark, d):
    return S.state(events(spark, d))


@query("WITH " + _EVENTS + """, s AS (SELECT session_id, max((length(text) % 11 = 0)::INT) = 1 AS bypassed, count(*) FILTER (kind = 'decision' AND length(text) % 2 = 0) AS n_selected, count(*) FILTER (length(text) % 3 = 0) AS n_missing, count(*) > 3 AS fetched FROM ev GROUP BY 1)
SELECT session_id, CASE WHEN bypassed THEN 'bypassed' WHEN n_selected > 0 THEN 'compliant' WHEN n_missing > 0 THEN 'missing_context_recorded' WHEN fetched THEN 'needs_decision' ELSE 'non_compliant' END AS verdict FROM s""")
def session_compliance(spark, d):
    n = F.length("text")
    s = events(spark, d).groupBy("session_id").agg((F.max((n % 11 == 0).cast("int")) == 1).alias("bypassed"), F.count_if((F.col("kind") == "decision") & (n % 2 == 0)).alias("n_selected"), F.count_if(n % 3 == 0).alias("n_missing"), (F.count("*") > 3).alias("fetched"))
    return s.select("session_id", S.compliance(F.col("bypassed"), F.col("n_selected"), F.col("n_missing"), F.col("fetched")).alias("verdict"))


@query("""WITH q AS (SELECT event_type AS queue, event_id AS item_id, CASE event_id % 4 WHEN 0 THEN 'needs_changes' WHEN 1 THEN 'pending' ELSE 'closed' END AS status, ts AS at_time FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY at_time DESC, item_id) AS n FROM q QUALIFY n <= 8)
SELECT queue, item_id, status, at_time AS "at", CASE status WHEN 'needs_changes' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END AS urgency FROM n ORDER BY urgency, at_time DESC, queue, item_id LIMIT 12""")
def review_targets(spark, d):
    k = F.col("event_id") % 4
    rows = read(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("item_id"), F.when(k == 0, "needs_changes").when(k == 1, "pending").otherwise("closed").alias("status"), F.col("ts").alias("at"))
    return S.review_queue(rows)


_CATEGORY = "CASE WHEN item_type IN ('rule', 'spec') THEN 'guard' WHEN item_type IN ('code_ref', 'bugfix') THEN 'direct' ELSE 'background' END"


@query(BOTH + ",\n" + FUSED.format("hits") + f", c AS (SELECT query_id, fused.item_id, rank, {_CATEGORY} AS category FROM fused JOIN items ON items.item_id = fused.item_id) SELECT query_id, item_id, rank, category FROM c QUALIFY row_number() OVER (PARTITION BY query_id, category ORDER BY rank) <= CASE category WHEN 'guard' THEN 6 WHEN 'direct' THEN 4 ELSE 1073741824 END")
def category_caps(spark, d):
    t = F.col("item_type")
    category = F.when(t.isin("rule", "spec"), "guard").when(t.isin("code_ref", "bugfix"), "direct").otherwise("background")
    c = plain(spark, d).join(items(spark, d).select("item_id", "item_type"), "item_id").select("query_id", "item_id", "rank", category.alias("category"))
    return S.capped(c, {"guard": 6, "direct": 4})


@query(with_("prompts") + """, s AS (SELECT query_id, unnest([lower(p_brand), split_part(p_name, ' ', 1)]) AS value, p_type FROM prompts WHERE query_id % 100 = 0),
seeds AS (SELECT p.query_id, q.p_partkey AS item_id, q.p_name || ' ' || q.p_brand AS content FROM prompts p JOIN part q ON q.p_type = p.p_type AND q.p_size = p.p_size WHERE p.query_id % 100 = 0)
SELECT s.query_id, value, list_sort(list_distinct(list(item_id))) AS by_items FROM s JOIN seeds ON seeds.query_id = s.query_id AND contains(lower(content), lower(value)) GROUP BY 1, 2""")
def seed_signals(spark, d):
    """Signals of every 100th prompt that items of its own type and size hold."""
    p = prompts(spark, d).where("query_id % 100 = 0")
    signals = p.select("query_id", F.explode(F.array(F.lower("p_brand"), F.element_at(F.split("p_name", " "), 1))).alias("value"))
    seeds = p.select("query_id", "p_type", "p_size").join(read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_type", "p_size", F.concat_ws(" ", "p_name", "p_brand").alias("content")), ["p_type", "p_size"])
    return S.covered_signals(signals, seeds.select("query_id", "item_id", "content")).withColumnRenamed("by", "by_items")


_FILES = """f AS (SELECT o_custkey AS query_id, 'src/f' || o_orderkey % 40 || '.ts' AS path, CASE o_orderkey % 4 WHEN 0 THEN 'prompt_named' WHEN 1 THEN 'git_changed' WHEN 2 THEN 'handoff' ELSE 'recent' END AS reason, o_orderdate AS modified FROM orders),
s AS (SELECT *, CASE reason WHEN 'prompt_named' THEN 1.0 WHEN 'git_changed' THEN 0.85 WHEN 'handoff' THEN 0.75 ELSE 0.6 END::DOUBLE AS score FROM f)"""


@query("WITH " + _FILES + """, u AS (SELECT query_id, path, reason, score, max(modified) AS modified FROM s GROUP BY ALL), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC) = 1),
k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, reason ORDER BY modified DESC, path) <= 2) SELECT query_id, path, reason, score FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, modified DESC, path) <= 8""")
def worktree_files(spark, d):
    k = F.col("o_orderkey") % 4
    reason = F.when(k == 0, "prompt_named").when(k == 1, "git_changed").when(k == 2, "handoff").otherwise("recent")
    f = read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("src/f"), (F.col("o_orderkey") % 40).cast("string"), F.lit(".ts")).alias("path"), reason.alias("reason"), F.col("o_orderdate").alias("modified"))
    return S.worktree(f.groupBy("query_id", "path", "reason").agg(F.max("modified").alias("modified")), 8)


@query()
def chunk_split(spark, d):
    """Chunks of every document; held against plain Python in the tests."""
    return chunking.chunk_split(read(spark, d, "documents").select("doc_id", "text"))


@query()
def markdown_atoms(spark, d):
    """Sections of documents read as Markdown, each under a heading of its own source and language."""
    text = F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n"), "text")
    return chunking.markdown_sections(read(spark, d, "documents").select("doc_id", text.alias("text")))


@query()
def greedy_clusters(spark, d):
    """First-fit clusters of the vectors of each label."""
    return chunking.first_fit(vectors(spark, d).select(F.col("label").alias("owner"), "item_id", "vector"), 0.3)

"""Evaluation of the searches and of labels, with relevance made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .bridge import read
from .ranking_queries import BOTH, FUSED, both, plain
from .registry import query


def marked(spark, d, found):
    """found (query_id, item_id, ...) with good: an item is expected for a query of its own language and quality label 1."""
    docs = read(spark, d, "documents").select("doc_id", "lang")
    labels = read(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("wanted"))
    own = docs.join(labels, "doc_id", "left_semi").select(F.col("doc_id").alias("item_id"), "lang")
    rows = found.join(q, "query_id", "left").join(own, "item_id", "left")
    return rows.withColumn("good", F.coalesce((F.col("wanted") == F.col("lang")) & (F.col("query_id") != F.col("item_id")), F.lit(False))).drop("wanted", "lang")


def expecting(spark, d):
    """Queries that expect something: their language has an item of quality 1 other than the query itself."""
    docs = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    two = docs.groupBy("lang").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    q = read(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "lang")
    return q.join(F.broadcast(two), "lang").where("query_id <> lo OR query_id <> hi").select("query_id").distinct()


_GOOD = "good AS (SELECT q.doc_id AS query_id, d.doc_id AS item_id FROM documents q JOIN documents d ON q.lang = d.lang JOIN labels l ON l.doc_id = d.doc_id WHERE q.doc_id % 100 = 0 AND quality = 1 AND q.doc_id <> d.doc_id)"


@query(BOTH + ",\n" + FUSED.format("hits") + ",\n" + _GOOD + """,
g AS (SELECT f.query_id, min(f.rank) AS first, count(*) FILTER (f.rank <= 5) AS n_good FROM fused f JOIN good USING (query_id, item_id) GROUP BY 1),
s AS (SELECT query_id, count(*) AS n FROM fused WHERE rank <= 5 GROUP BY 1),
p AS (SELECT s.query_id, CASE WHEN s.query_id NOT IN (SELECT query_id FROM good) THEN 1 ELSE coalesce((first <= 5)::INT, 0) END AS hit, coalesce(1 / first, 0)::DOUBLE AS reciprocal, coalesce(n_good, 0) / n AS precision FROM s LEFT JOIN g ON g.query_id = s.query_id)
SELECT count(*) AS n, floor(avg(hit) * 10000 + 0.5) / 10000 AS hit_rate, floor(avg(reciprocal) * 10000 + 0.5) / 10000 AS mrr, floor(avg(precision) * 10000 + 0.5) / 10000 AS precision FROM p""")
def hit_mrr(spark, d):
    return E.hit_rate(E.judged(marked(spark, d, plain(spark, d)), expecting(spark, d), 5))


_CONF = "count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn"


@query(f"""WITH c AS (SELECT lang, quality = 0 AS a, regexp_matches(text, '[#$%&*]{{3}}') AS p FROM documents JOIN labels USING (doc_id)), n AS (SELECT lang, {_CONF} FROM c GROUP BY lang)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM n""")
def confusion_f1(spark, d):
    """How well runs of symbols tell documents labelled bad, by language."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return E.confusion(rows, F.col("quality") == 0, F.col("text").rlike("[#$%&*]{3}"), "lang")


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS at_place, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(value) FILTER (at_place = floor(0.5 * n)) AS p50, min(value) FILTER (at_place = floor(0.95 * n)) AS p95, max(value) AS most FROM n GROUP BY 1""")
def latency_percentile(spark, d):
    return E.nearest_rank(read(spark, d, "events"), "value", (0.5, 0.95), "event_type")


@query(BOTH + ",\n" + _GOOD + """,
r AS (SELECT h.query_id, h.item_id, h.rank, CASE source WHEN 'lexical' THEN 1.0::DOUBLE ELSE 0.92::DOUBLE END AS w, (g.item_id IS NOT NULL)::INT AS good FROM hits h LEFT JOIN good g ON g.query_id = h.query_id AND g.item_id = h.item_id),
s AS (SELECT k, query_id, item_id, sum(w / (k + rank)) AS s, max(good) AS good FROM r, (VALUES (10), (30), (60), (90)) t(k) GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY round(s, 9) DESC, item_id) AS place FROM s QUALIFY place <= 5), n AS (SELECT k, sum(good)::BIGINT AS n_hits FROM t GROUP BY 1)
SELECT k, n_hits, row_number() OVER (ORDER BY n_hits DESC, k <> 60, k) = 1 AS best FROM n""")
def calibrate_k(spark, d):
    rows = marked(spark, d, both(spark, d))
    weight = F.when(F.col("source") == "lexical", 1.0).otherwise(0.92)
    return E.calibrate_k(rows.select("query_id", "item_id", "rank", weight.alias("weight"), F.col("good").cast("int").alias("good")), (10, 30, 60, 90))


@query("""WITH b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./:-]{4,}'))) AS fact FROM benchmark),
v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]{4,}')) AS fact FROM conversations)
SELECT item_id, count(*) AS n_facts, count(v.fact) AS n_found, round(count(v.fact) / count(*), 6) AS completeness FROM b LEFT JOIN v ON v.fact = b.fact GROUP BY 1""")
def completeness(spark, d):
    """The share of each passage's words that the conversations hold."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_./:-]{4,})"), F.lit(1))
    b = read(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(words("text"))).alias("fact"))
    v = read(spark, d, "conversations").select(F.explode(words("text")).alias("fact")).distinct().withColumn("hit", F.lit(1))
    return b.join(v, "fact", "left").groupBy("item_id").agg(F.count("*").alias("n_facts"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 6).alias("completeness"))

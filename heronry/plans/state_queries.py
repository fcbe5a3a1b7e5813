"""Resulting states: upserts, expiry, policies, proposals, retries and reranking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import policy as P
from ..functions import text as T
from ..operators import state as S
from .bridge import AS_OF, atoms, edges, feedback, items, read, with_
from .ranking_queries import BOTH, FUSED, plain
from .registry import query
from .search_queries import LEXICAL, lexical_queries

_NEW = "SELECT p_partkey, p_name || ' v2' AS name, p_size + 1 AS size FROM part WHERE p_partkey % 3 = 0"


@query(f"WITH n AS ({_NEW}) SELECT p_partkey, p_name AS name, p_size AS size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM n) UNION ALL SELECT * FROM n")
def upsert_items(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    new = p.where("p_partkey % 3 = 0").select("p_partkey", F.concat("name", F.lit(" v2")).alias("name"), (F.col("size") + 1).alias("size"))
    return S.upsert(p, new, "p_partkey")


@query(with_("atoms", "edges") + f" SELECT src, dst, kind, CASE WHEN status = 'archived' THEN TIMESTAMP '{AS_OF}' END AS valid_until FROM edges LEFT JOIN atoms ON atom_id = src AND status = 'archived'")
def expired_edges(spark, d):
    gone = atoms(spark, d).where("status = 'archived'").select(F.col("atom_id").alias("item_id"))
    found = S.expire(edges(spark, d).withColumn("valid_until", F.lit(None).cast("timestamp")), gone, AS_OF)
    return found.select("src", "dst", "kind", F.col("valid_until").cast("timestamp_ntz").alias("valid_until"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT l_linenumber % 5 AS kind, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN l_shipdate::DATE::VARCHAR ELSE 'unknown' END AS valid_until FROM lineitem) WHERE try_cast(valid_until AS TIMESTAMP) IS NULL OR try_cast(valid_until AS TIMESTAMP) > TIMESTAMP '1996-06-30' GROUP BY kind")
def valid_edges(spark, d):
    k = F.col("l_linenumber")
    e = read(spark, d, "lineitem").select((k % 5).alias("kind"), F.when(k % 3 == 1, F.col("l_shipdate").cast("date").cast("string")).when(k % 3 == 2, "unknown").alias("valid_until"))
    return S.valid(e, "1996-06-30").groupBy("kind").agg(F.count("*").alias("n"))


_PATH = "CASE page_id % 6 WHEN 0 THEN 'node_modules/x/' WHEN 1 THEN 'src/dist/' ELSE 'docs/' END || page_id || CASE page_id % 4 WHEN 0 THEN '.PNG' ELSE '.md' END"


@query(rf"SELECT page_id, {_PATH} AS path, CASE WHEN regexp_matches({_PATH}, '(^|/)(node_modules|\.git|dist|build|coverage)/') THEN 'excluded' WHEN regexp_matches(lower({_PATH}), '\.(png|jpe?g|gif|pdf|zip|gz|jar|ico|woff2?)$') THEN 'binary' WHEN length(html) > 3000 THEN 'too_large' END AS reason FROM pages")
def path_policy(spark, d):
    k = F.col("page_id")
    path = F.concat(F.when(k % 6 == 0, "node_modules/x/").when(k % 6 == 1, "src/dist/").otherwise("docs/"), k.cast("string"), F.when(k % 4 == 0, ".PNG").otherwise(".md"))
    return read(spark, d, "pages").select("page_id", path.alias("path"), S.path_policy(path, F.length("html"), 3000).alias("reason"))


_KIND_SQL = "CASE item_type " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in P.NAMESPACE_KINDS.items()) + " ELSE item_type END"
_META = """CASE item_id % 4 WHEN 0 THEN '{"agentName":" ' || lang || ' "}' WHEN 1 THEN '{"agentTool":"t' || item_id % 3 || '"}' WHEN 2 THEN '{"agentName":"  "}' ELSE '{}' END"""


def _metadata():
    k = F.col("item_id")
    return F.when(k % 4 == 0, F.concat(F.lit('{"agentName":" '), "lang", F.lit(' "}'))).when(k % 4 == 1, F.concat(F.lit('{"agentTool":"t'), (k % 3).cast("string"), F.lit('"}'))).when(k % 4 == 2, '{"agentName":"  "}').otherwise("{}")


_SPACES = with_("items") + f", ns AS (SELECT item_id, project, {_KIND_SQL} AS kind, nullif(trim(coalesce(json_extract_string({_META}, '$.agentName'), json_extract_string({_META}, '$.agentTool'))), '') AS agent FROM items)"


@query(_SPACES + " SELECT * FROM ns")
def namespaces(spark, d):
    return items(spark, d).select("item_id", S.namespace(F.col("project"), F.col("item_type"), _metadata()).alias("n")).select("item_id", "n.*")


@query(_SPACES + " SELECT item_id FROM ns WHERE kind = 'reflection' AND agent = 'en'")
def namespace_filter(spark, d):
    """Candidates of one kind and agent; those without an agent fail."""
    n = items(spark, d).select("item_id", S.namespace(F.col("project"), F.col("item_type"), _metadata()).alias("n"))
    return n.where(S.in_namespace(F.col("n"), kind="reflection", agent="en")).select("item_id")


@query(with_("atoms", "feedback") + """, n AS (SELECT item_id, count(*) AS n, max(ts) AS ts FROM feedback WHERE feedback_type = 'selected' GROUP BY 1)
SELECT atom_id, reuse + coalesce(n, 0) AS reuse, greatest(last_reused, ts) AS last_reused FROM atoms LEFT JOIN n ON n.item_id = atom_id""")
def reuse_increment(spark, d):
    positive = feedback(spark, d).where("feedback_type = 'selected'").select(F.col("item_id").alias("atom_id"), "ts")
    return S.reuse(atoms(spark, d).select("atom_id", "reuse", "last_reused"), positive)


_PROPOSED = "p AS (SELECT item_id, CASE feedback_type WHEN 'stale' THEN 'mark_stale' WHEN 'rejected' THEN 'review' WHEN 'irrelevant' THEN 'narrow_labels' END AS action, count(*) AS n FROM feedback WHERE feedback_type IN ('stale', 'rejected', 'irrelevant') GROUP BY 1, 2)"


@query(with_("feedback") + ",\n" + _PROPOSED + " SELECT * FROM p")
def learning_proposals(spark, d):
    return S.proposals(feedback(spark, d))


@query(with_("items", "feedback") + ",\n" + _PROPOSED + """, a AS (SELECT item_id, max(CASE action WHEN 'mark_stale' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) AS a FROM p WHERE n >= 3 GROUP BY 1)
SELECT items.item_id, CASE a WHEN 2 THEN 'archived' WHEN 1 THEN 'needs_review' ELSE status END AS status FROM items LEFT JOIN a ON a.item_id = items.item_id""")
def proposals_applied(spark, d):
    return S.applied(items(spark, d), S.proposals(feedback(spark, d)).where("n >= 3"))


@query("SELECT s_suppkey AS key, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN c_name ELSE CASE WHEN s_name = c_name THEN s_name ELSE s_name || ' | ' || c_name END END AS value FROM supplier JOIN customer ON c_custkey = s_suppkey")
def conflicts_resolved(spark, d):
    k = F.col("key")
    q = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("local")).join(read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("imported")), "key")
    return S.resolved(q, F.when(k % 3 == 0, "keep").when(k % 3 == 1, "take").otherwise("merge"))


@query(BOTH + ",\n" + FUSED.format("hits") + " SELECT query_id, item_id, score, rank - 5 AS rank FROM fused WHERE rank > 5 AND rank <= 15")
def retry_search(spark, d):
    """The next ten when the first five were rejected."""
    f = plain(spark, d)
    return S.retried(f.select("query_id", "item_id", "score"), f.where("rank <= 5"), 10)


@query(BOTH + ",\n" + FUSED.format("hits") + """,
t AS (SELECT query_id, item_id, score, terms, trust, list_distinct(regexp_extract_all(lower(content), '[a-z0-9_./:-]+')) AS tokens FROM fused JOIN lq USING (query_id) LEFT JOIN items USING (item_id)),
r AS (SELECT query_id, item_id, coalesce(len(list_intersect(terms, coalesce(tokens, []))) / nullif(len(terms), 0), 0) AS overlap, least(1, greatest(0, coalesce(trust / 100, 0))) AS own, score FROM t),
f2 AS (SELECT query_id, item_id, round(overlap, 6) AS overlap, round(least(1, greatest(0, 0.62::DOUBLE * score + 0.28::DOUBLE * overlap + 0.1::DOUBLE * own)), 6) AS final FROM r) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item_id) AS rank FROM f2""")
def term_rerank(spark, d):
    return S.rerank(plain(spark, d), lexical_queries(spark, d), items(spark, d))


@query("WITH " + LEXICAL.split("lt AS")[0] + """q AS (SELECT query_id, terms[1:2] AS exact, terms, 0.5::DOUBLE AS confidence FROM lq),
b AS (SELECT item_id * 100 AS query_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./:-]{3,}'))) AS l FROM benchmark WHERE item_id % 2 = 0),
j AS (SELECT q.*, CASE WHEN b.query_id % 400 = 0 THEN l[1:3] ELSE [] END AS more_exact, l[1:32] AS more FROM q LEFT JOIN b ON b.query_id = q.query_id),
m AS (SELECT *, CASE WHEN more IS NOT NULL THEN (exact || list_filter(more_exact, lambda x: NOT list_contains(exact, x)))[1:48] END AS merged FROM j),
c AS (SELECT *, merged || more || terms AS l FROM m)
SELECT query_id, array_to_string(coalesce(merged, exact), ' ') AS exact, array_to_string(CASE WHEN merged IS NULL THEN terms ELSE (list_filter(l, lambda x, i: list_position(l, x) = i))[1:64] END, ' ') AS terms,
 round(CASE WHEN merged IS NULL THEN confidence ELSE least(0.98, confidence + CASE WHEN len(merged) > len(exact) THEN 0.06 ELSE 0.03 END) END, 6)::DOUBLE AS confidence FROM c""")
def rewrite_merge(spark, d):
    """Queries with the terms of a benchmark passage as their rewrite, for those that have one."""
    own = F.array_sort(T.tokens(F.col("text")))
    more = read(spark, d, "benchmark").where("item_id % 2 = 0").select((F.col("item_id") * 100).alias("query_id"), own.alias("l"))
    more = more.select("query_id", F.when(F.col("query_id") % 400 == 0, F.slice("l", 1, 3)).otherwise(F.slice("l", 1, 0)).alias("exact"), F.slice("l", 1, 32).alias("terms"))
    q = lexical_queries(spark, d).select("query_id", F.slice("terms", 1, 2).alias("exact"), "terms", F.lit(0.5).alias("confidence"))
    return S.rewritten(q, more).select("query_id", F.array_join("exact", " ").alias("exact"), F.array_join("terms", " ").alias("terms"), "confidence")


@query(with_("edges") + """, p AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE 'src/' || split_part(p_name, ' ', 1) END AS area FROM part)
SELECT a.area, b.area AS needs, round(sum(confidence), 4) AS weight, sha256(a.area || '>' || b.area) AS digest FROM edges JOIN p a ON a.item_id = src JOIN p b ON b.item_id = dst WHERE a.area <> b.area GROUP BY 1, 2""")
def area_dependencies(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lower("p_type"), F.lit("/x"))).otherwise(F.concat(F.lit("src/"), F.element_at(F.split("p_name", " "), 1), F.lit("/x")))
    return S.area_dependencies(read(spark, d, "part").select(k.alias("item_id"), path.alias("path")), edges(spark, d))


@query("SELECT coalesce(lang, 'all') AS taxon, count(*) AS n, round(avg(quality), 6) AS precision, round(avg(toxic), 6) AS noise FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def mapping_by_taxon(spark, d):
    """Measures for each language and over all, in one pass."""
    rows = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id")
    return rows.cube("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("precision"), F.round(F.avg("toxic"), 6).alias("noise")).select(F.coalesce("lang", F.lit("all")).alias("taxon"), "n", "precision", "noise")

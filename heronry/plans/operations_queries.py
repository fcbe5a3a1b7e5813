"""Listings, rollups, review, source diffs, incidents and retention over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import operations as O
from ..operators import ranking as R
from .bridge import AS_OF, atoms, edges, feedback, items, read, with_
from .ranking_queries import SUMMARY
from .registry import query


@query(with_("items") + " SELECT item_id, project, fresh_on FROM items WHERE status = 'approved' AND project = 'src3' AND (contains(content, 'the') OR contains(content, 'der')) ORDER BY fresh_on DESC, item_id LIMIT 50")
def item_listing(spark, d):
    """The newest approved items of a project that hold a word: a page of 50."""
    i = items(spark, d).where("status = 'approved' AND project = 'src3' AND (contains(content, 'the') OR contains(content, 'der'))")
    return i.select("item_id", "project", "fresh_on").orderBy(F.desc("fresh_on"), "item_id").limit(50)


@query("SELECT p_type, p_brand, round(avg(p_size), 6) AS avg_weight, count(*) AS n FROM part GROUP BY 1, 2")
def label_stats(spark, d):
    return read(spark, d, "part").groupBy("p_type", "p_brand").agg(F.round(F.avg("p_size"), 6).alias("avg_weight"), F.count("*").alias("n"))


@query(with_("items", "edges") + """ SELECT 'item' AS what, project AS value, count(*) AS n FROM items GROUP BY project UNION ALL SELECT 'relation', kind, count(*) FROM edges GROUP BY kind""")
def project_map(spark, d):
    i = items(spark, d).groupBy(F.lit("item").alias("what"), F.col("project").alias("value")).agg(F.count("*").alias("n"))
    return i.unionByName(edges(spark, d).groupBy(F.lit("relation").alias("what"), F.col("kind").alias("value")).agg(F.count("*").alias("n")))


@query(with_("atoms", "edges") + " SELECT (SELECT count(*) FROM atoms) AS n_atoms, (SELECT count(*) FROM edges) AS n_edges, round((SELECT count(*) FROM edges) / (SELECT count(*) FROM atoms), 6) AS edges_an_atom, (SELECT count(DISTINCT src) FROM edges) AS n_sources")
def graph_density(spark, d):
    e = edges(spark, d).agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_sources"))
    return atoms(spark, d).agg(F.count("*").alias("n_atoms")).crossJoin(e).select("n_atoms", "n_edges", F.round(F.col("n_edges") / F.col("n_atoms"), 6).alias("edges_an_atom"), "n_sources")


def _reviewed(spark, d):
    k = F.col("item_id")
    return items(spark, d).select("item_id", "status", "trust", F.when(k % 23 == 0, "blocked").when(k % 29 == 0, "suspicious").otherwise("clean").alias("safety"), F.when(k % 4 == 0, "agent_session_finish").otherwise("user").alias("origin"))


def _references(spark, d):
    e = edges(spark, d)
    return e.select(F.col("src").alias("item_id"), F.when(F.col("kind") == "related_to", "conversation").otherwise("file").alias("kind"))


@query(with_("items", "feedback", "edges") + ",\n" + SUMMARY + """,
r AS (SELECT src AS item_id, count(*) AS n_refs, count(*) FILTER (kind <> 'related_to') AS n_grounded FROM edges GROUP BY 1),
j AS (SELECT i.item_id, i.item_id % 23 = 0 OR i.item_id % 29 = 0 AS unsafe, trust < 50 AS low_trust, coalesce(n_stale, 0) > 0 AS stale, coalesce(n_rejected, 0) > 0 AS rejected, coalesce(n_irrelevant, 0) > 0 AS irrelevant, i.status, i.item_id % 4 = 0 AS auto_memory, coalesce(n_refs, 0) AS n_refs, coalesce(n_grounded, 0) AS n_grounded
 FROM items i LEFT JOIN summary s ON s.item_id = i.item_id LEFT JOIN r ON r.item_id = i.item_id),
q AS (SELECT *, unsafe OR low_trust OR stale OR rejected OR irrelevant OR status <> 'approved' AS questionable FROM j)
SELECT item_id, unsafe, low_trust, stale, rejected, irrelevant, questionable, n_refs = 0 AS orphaned, auto_memory, auto_memory AND (questionable OR n_grounded = 0) AS risky_auto_memory FROM q""")
def review_filters(spark, d):
    return O.review_flags(_reviewed(spark, d), R.feedback_summary(feedback(spark, d)), _references(spark, d))


_PLAN = """l AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS old FROM documents WHERE doc_id % 5 <> 0),
i AS (SELECT 'docs/' || CASE WHEN doc_id % 11 = 0 THEN 'moved' ELSE source END || '/' || doc_id || '.md' AS path, sha256(text) AS new, doc_id % 13 = 0 AS ignored FROM documents WHERE doc_id % 6 <> 0),
j AS (SELECT coalesce(l.path, i.path) AS path, old, new, CASE WHEN ignored THEN 'ignored' WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' WHEN old <> new THEN 'changed' ELSE 'unchanged' END AS action FROM l FULL JOIN i ON l.path = i.path),
gone AS (SELECT old AS h, path AS prior, row_number() OVER (PARTITION BY old ORDER BY path) AS n FROM j WHERE action = 'deleted'),
came AS (SELECT new AS h, path, row_number() OVER (PARTITION BY new ORDER BY path) AS n FROM j WHERE action = 'added'),
moved AS (SELECT came.path, gone.prior FROM came JOIN gone ON came.h = gone.h AND came.n = gone.n),
plan AS (SELECT j.path, CASE WHEN m.prior IS NOT NULL THEN 'renamed' ELSE action END AS action, m.prior FROM j LEFT JOIN moved m ON m.path = j.path WHERE j.path NOT IN (SELECT prior FROM moved))"""


def _ledger(spark, d):
    k = F.col("doc_id")
    t = read(spark, d, "documents").where(k % 5 != 0)
    return t.select(F.concat(F.lit("docs/"), "source", F.lit("/"), k.cast("string"), F.lit(".md")).alias("path"), F.sha2(F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))


def _inventory(spark, d):
    k = F.col("doc_id")
    t = read(spark, d, "documents").where(k % 6 != 0)
    return t.select(F.concat(F.lit("docs/"), F.when(k % 11 == 0, "moved").otherwise(F.col("source")), F.lit("/"), k.cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("hash"), (k % 13 == 0).alias("skip"))


@query("WITH " + _PLAN + " SELECT path, action, prior FROM plan")
def sync_plan(spark, d):
    """Ledger against inventory: each lacks some paths, some texts differ and some files have moved, as the ledger's rules say."""
    return O.sync_plan(_ledger(spark, d), _inventory(spark, d), F.col("skip"))


@query("WITH " + _PLAN + " SELECT action, count(*) AS n FROM plan GROUP BY action")
def source_health(spark, d):
    return sync_plan(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n_stale FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source")
def stale_anti(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n_stale"))


@query("""SELECT (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS n_idle_sources, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-05') AS n_old_events,
 (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS n_orphans""")
def cleanup_counts(spark, d):
    """What a dry run of the clean-up would delete, as one row."""
    idle = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("n_idle_sources"))
    old = read(spark, d, "events").where(F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")).agg(F.count("*").alias("n_old_events"))
    orphans = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id", "left_anti").agg(F.count("*").alias("n_orphans"))
    return idle.crossJoin(old).crossJoin(orphans)


_ERRORS = """err AS (SELECT event_id, 'Failure of ' || event_type || ' ' || (event_id % 9) || ' at 0x' || lower(hex(event_id)) || ' user ' || user_id % 3 || ' code ' || chr((97 + user_id % 5)::INT) AS message, (user_id % 8)::INT AS severity, CASE WHEN user_id % 2 = 0 THEN 'runtime' ELSE 'build' END AS category, (1 + user_id % 4) AS occurrences, ts FROM events WHERE event_type = 'error')"""


def errors(spark, d):
    u = F.col("user_id")
    message = F.concat(F.lit("Failure of "), "event_type", F.lit(" "), (F.col("event_id") % 9).cast("string"), F.lit(" at 0x"), F.lower(F.hex("event_id")), F.lit(" user "), (u % 3).cast("string"), F.lit(" code "), F.char(97 + u % 5))
    e = read(spark, d, "events").where("event_type = 'error'")
    return e.select("event_id", message.alias("message"), (u % 8).cast("int").alias("severity"), F.when(u % 2 == 0, "runtime").otherwise("build").alias("category"), (1 + u % 4).alias("occurrences"), "ts")


@query("WITH " + _ERRORS + r""", k AS (SELECT *, sha256(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(message), '0x[0-9a-f]+|\b[0-9a-f]{8,}\b', '<hex>', 'g'), '\d+', '<n>', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 1, 240)) AS fingerprint FROM err)
SELECT fingerprint, count(*) AS n, sum(occurrences)::BIGINT AS occurrences, max(severity) AS severity, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, min(ts) AS first_seen, max(ts) AS last_seen FROM k GROUP BY fingerprint ORDER BY occurrences DESC, severity DESC, last_seen DESC, fingerprint LIMIT 20""")
def error_clusters(spark, d):
    return O.error_clusters(errors(spark, d))


@query("WITH " + _ERRORS + ", e AS (SELECT *, event_id % 5 AS area FROM err) SELECT 'category' AS dimension, category AS value, count(*) AS n, sum(occurrences)::BIGINT AS total FROM e GROUP BY 2 UNION ALL SELECT 'severity', severity::VARCHAR, count(*), sum(occurrences)::BIGINT FROM e GROUP BY 2 UNION ALL SELECT 'area', area::VARCHAR, count(*), sum(occurrences)::BIGINT FROM e GROUP BY 2")
def error_rollups(spark, d):
    return O.rollups(errors(spark, d).withColumn("area", F.col("event_id") % 5), ("category", "severity", "area"), "occurrences")


@query("""WITH p AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 9 = 0 THEN 'README.md' WHEN p_partkey % 3 = 0 THEN lower(p_type) || '/' || p_name ELSE 'src/' || split_part(p_name, ' ', 1) || '/' || p_name END AS path FROM part),
a AS (SELECT item_id, CASE WHEN len(s) = 1 THEN '_root' WHEN s[1] = 'src' THEN 'src/' || s[2] ELSE s[1] END AS area FROM (SELECT *, string_split(path, '/') AS s FROM p)),
e AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v FROM lineitem WHERE l_partkey <> l_suppkey),
c AS (SELECT unnest([x.area, y.area]) AS area FROM e JOIN a x ON x.item_id = u JOIN a y ON y.item_id = v WHERE x.area <> y.area), n AS (SELECT area, count(*) AS n_crossing FROM c GROUP BY 1)
SELECT a.area, CASE WHEN a.area = '_root' THEN 'Root' ELSE upper(string_split(a.area, '/')[-1][1]) || substr(string_split(a.area, '/')[-1], 2) END AS label, count(*) AS n_items, coalesce(any_value(n_crossing), 0) AS n_crossing FROM a LEFT JOIN n ON n.area = a.area GROUP BY a.area""")
def area_model(spark, d):
    k = F.col("p_partkey")
    first = F.element_at(F.split("p_name", " "), 1)
    path = F.when(k % 9 == 0, "README.md").when(k % 3 == 0, F.concat(F.lower("p_type"), F.lit("/"), "p_name")).otherwise(F.concat(F.lit("src/"), first, F.lit("/"), "p_name"))
    return O.area_model(read(spark, d, "part").select(k.alias("item_id"), path.alias("path")), edges(spark, d))


@query(f"""WITH b AS (SELECT 'backup-' || s_suppkey AS path, TIMESTAMP '{AS_OF}' - INTERVAL (s_suppkey * 7) HOUR AS created, s_suppkey % 3 = 0 AS ok, s_suppkey % 4 <> 1 AS verified FROM supplier),
p AS (SELECT *, row_number() OVER (ORDER BY created DESC, path) AS n, row_number() OVER (PARTITION BY ok ORDER BY created DESC, path) AS k FROM b) SELECT path, n <= 3 OR (ok AND k = 1) OR NOT verified AS keep FROM p""")
def backup_retention(spark, d):
    k = F.col("s_suppkey")
    made = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(0), (k * 7).cast("int"))
    return O.retention(read(spark, d, "supplier").select(F.concat(F.lit("backup-"), k.cast("string")).alias("path"), made.alias("created"), (k % 3 == 0).alias("ok"), (k % 4 != 1).alias("verified")), 3)


@query(with_("atoms", "edges") + """ SELECT 'tier' AS kind, atom_id AS item_id FROM atoms WHERE tier = 'draft' AND reuse > 35 UNION ALL SELECT 'archived', atom_id FROM atoms WHERE status = 'archived'
 UNION ALL SELECT 'weak_edge', src FROM (SELECT DISTINCT src FROM edges WHERE confidence < 0.91) UNION ALL SELECT 'unlinked', atom_id FROM atoms WHERE atom_id NOT IN (SELECT src FROM edges)""")
def maintenance_items(spark, d):
    """Proposals of four kinds."""
    a, e = atoms(spark, d), edges(spark, d)
    tag = lambda k, rows: rows.select(F.lit(k).alias("kind"), "item_id")
    a = a.withColumnRenamed("atom_id", "item_id")
    src = e.select(F.col("src").alias("item_id"))
    weak = e.where("confidence < 0.91").select(F.col("src").alias("item_id")).distinct()
    return tag("tier", a.where("tier = 'draft' AND reuse > 35")).unionByName(tag("archived", a.where("status = 'archived'"))).unionByName(tag("weak_edge", weak)).unionByName(tag("unlinked", a.join(src, "item_id", "left_anti")))

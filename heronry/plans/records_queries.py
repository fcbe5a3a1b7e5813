"""Scans, listings, filters, rollups and states of records over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest
from ..operators import operations as O
from ..operators import ranking as R
from ..operators import records as D
from ..operators import search as S
from ..operators import signals
from . import kb as K
from .bridge import AS_OF, atoms, edges, items, prompts, read, with_
from .operations_queries import _ERRORS, errors
from .registry import query
from .search_queries import vectors
from .state_queries import _SPACES  # noqa: F401

_KB = "WITH " + K.KB + ",\n" + K.LABELS
_JSON = lambda a, b: f"'[' || coalesce(string_agg('{{\"type\":\"' || {a} || '\",\"{b}\":\"' || {'value' if b == 'value' else b} || '\"}}', ',' ORDER BY {a}, {'value' if b == 'value' else b}), '') || ']'"


@query(_KB + f""", lj AS (SELECT item_id, {_JSON("type", "value")} AS labels FROM (SELECT DISTINCT item_id, type, value FROM kl) GROUP BY 1), rj AS (SELECT item_id, {_JSON("type", "uri")} AS refs FROM (SELECT DISTINCT item_id, 'file' AS type, unnest(files) AS uri FROM kc) GROUP BY 1)
SELECT kb.item_id, project, title, coalesce(lj.labels, '[]') AS labels, coalesce(rj.refs, '[]') AS "references" FROM kb LEFT JOIN lj ON lj.item_id = kb.item_id LEFT JOIN rj ON rj.item_id = kb.item_id""")
def item_scan(spark, d):
    """Every item with its labels and references as JSON."""
    refs = K.classified(spark, d).select("item_id", F.lit("file").alias("type"), F.explode("files").alias("uri"))
    return D.gathered(K.kb(spark, d).select("item_id", "project", "title"), K.labels(spark, d), refs)


@query(with_("items") + """ SELECT vec_id AS chunk_id, item_id, project, 'vector' AS source, round(trust / 100.0 * (1 - label / 100.0), 6)::DOUBLE AS raw, row_number() OVER (PARTITION BY item_id ORDER BY round(trust / 100.0 * (1 - label / 100.0), 6) DESC, vec_id) AS place
FROM (SELECT vec_id, vec_id // 2 AS item_id, label FROM embeddings) JOIN items USING (item_id) WHERE status = 'approved'""")
def chunk_candidates(spark, d):
    """Chunks of approved items, two to an item, with a score."""
    chunks = vectors(spark, d).select(F.col("item_id").alias("chunk_id"), F.expr("item_id div 2").alias("item_id"), "label")
    return D.chunk_candidates(chunks, items(spark, d), "vector", F.col("trust") / 100 * (1 - F.col("label") / 100))


@query("WITH " + K.KB + " SELECT item_id, project, title, fresh_on FROM kb WHERE status = 'approved' AND project = 'p1' AND trust < 50 AND contains(lower(title || chr(10) || summary || chr(10) || content), 'ing') ORDER BY fresh_on DESC, item_id LIMIT 50")
def items_filtered(spark, d):
    """The newest approved items of a project under a review filter (low trust) whose texts hold a word."""
    low = D.matching(K.kb(spark, d).where("trust < 50"), ("title", "summary", "content"), "ing")
    return D.listed(low, {"status": "approved", "project": "p1"}, "fresh_on", "item_id", 50).select("item_id", "project", "title", "fresh_on")


@query(with_("atoms") + " SELECT atom_id, tier, status, p_size FROM atoms WHERE tier = 'verified' AND status = 'active' AND p_size = 10 ORDER BY last_reused DESC NULLS LAST, atom_id LIMIT 40")
def atom_listing(spark, d):
    """Facts by any of their attributes; those left out ask for nothing."""
    return D.listed(atoms(spark, d), {"tier": "verified", "status": "active", "p_size": 10, "claim": None}, "last_reused", "atom_id", 40).select("atom_id", "tier", "status", "p_size")


@query(with_("atoms", "edges") + " SELECT src, dst, kind, confidence FROM edges e WHERE kind = 'refines' AND EXISTS (SELECT 1 FROM atoms a WHERE a.atom_id = e.src AND a.tier = 'canonical') ORDER BY confidence DESC, src, dst LIMIT 100")
def atom_relations(spark, d):
    """Relations of a kind out of facts of a tier, the surest first."""
    own = atoms(spark, d).where("tier = 'canonical'").select(F.col("atom_id").alias("src"))
    return edges(spark, d).where("kind = 'refines'").join(own, "src", "left_semi").orderBy(F.desc("confidence"), "src", "dst").limit(100).select("src", "dst", "kind", "confidence")


_QUEUE = "queue AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'gap' WHEN 'click' THEN 'proposal' WHEN 'error' THEN 'conflict' WHEN 'signup' THEN 'draft' ELSE 'session' END AS queue, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'dismissed' END AS status, ts FROM events)"


@query("WITH " + _QUEUE + " SELECT queue, id, status, ts FROM queue WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY queue ORDER BY ts DESC, id) <= 20")
def queue_listings(spark, d):
    """The newest open conflicts, gaps, proposals, drafts and sessions, twenty of each."""
    e = F.col("event_type")
    kind = F.when(e == "view", "gap").when(e == "click", "proposal").when(e == "error", "conflict").when(e == "signup", "draft").otherwise("session")
    k = F.col("event_id") % 3
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), kind.alias("queue"), F.when(k == 0, "open").when(k == 1, "resolved").otherwise("dismissed").alias("status"), "ts")
    kinds = ("gap", "proposal", "conflict", "draft", "session")
    parts = [D.listed(rows, {"queue": q, "status": "open"}, "ts", "id", 20) for q in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("queue", "id", "status", "ts")


_LOGS = _ERRORS + """, logs AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'ignored' END AS status, 'p' || user_id % 4 AS project, ['Tag' || user_id % 3, 'x'] AS tags, CASE user_id % 3 WHEN 0 THEN ' Bash' WHEN 1 THEN 'bash ' ELSE 'Edit' END AS tool, 'op' || event_id % 4 AS operation FROM err JOIN (SELECT event_id, user_id FROM events) USING (event_id))"""


def logs(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    own = read(spark, d, "events").select("event_id", "user_id")
    return errors(spark, d).join(own, "event_id").select(
        "*", F.when(k % 3 == 0, "open").when(k % 3 == 1, "resolved").otherwise("ignored").alias("status"), F.concat(F.lit("p"), (u % 4).cast("string")).alias("project"), F.array(F.concat(F.lit("Tag"), (u % 3).cast("string")), F.lit("x")).alias("tags"),
        F.when(u % 3 == 0, " Bash").when(u % 3 == 1, "bash ").otherwise("Edit").alias("tool"), F.concat(F.lit("op"), (k % 4).cast("string")).alias("operation"), F.col("ts").alias("last_seen"),
    )


@query("WITH " + _LOGS + " SELECT event_id FROM logs WHERE project = 'p1' AND category IN ('build', 'runtime') AND severity IN (1, 3, 5) AND status IN ('open', 'resolved') AND list_contains([lower(x) FOR x IN tags], 'tag1') AND contains(lower(message), 'user') AND ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-12-31'")
def error_filter(spark, d):
    """Incidents that meet all eight filters."""
    return D.errors_where(logs(spark, d), project="p1", categories=("build", "runtime"), severities=(1, 3, 5), statuses=("open", "resolved"), tag="TAG1", words="User", since="2024-01-01", until="2024-12-31").select("event_id")


_DIMS = ("category", "severity", "status", "project", "tool", "operation", "tag")


@query("WITH " + _LOGS + ", e AS (SELECT *, tags[1] AS tag FROM logs) " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c}::VARCHAR AS value, count(*) AS n, sum(occurrences)::BIGINT AS total FROM e GROUP BY {c}" for c in _DIMS))
def error_rollups_all(spark, d):
    """Incidents by each of seven dimensions, in one pass."""
    return O.rollups(logs(spark, d).withColumn("tag", F.get("tags", F.lit(0))), _DIMS, "occurrences")


@query("WITH " + _LOGS + """, v AS (SELECT category, trim(tool) AS v, event_id FROM logs) SELECT category, arg_min(v, event_id) AS value, count(*) AS n FROM v GROUP BY category, lower(v) QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, arg_min(v, event_id)) <= 8""")
def top_tools(spark, d):
    """The commonest tools of each category, whatever their case."""
    return D.top_values(logs(spark, d), "category", "tool", "event_id", 8)


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def value_counts(spark, d):
    return D.rollup_counts(read(spark, d, "events"), "event_type", 12)


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string('{\"safety\":{\"status\":\"' || event_type || '\"},\"stale\":true}', '$.safety.status') AS status FROM events")
def json_fields(spark, d):
    """Fields of JSON metadata, one of them nested."""
    e = read(spark, d, "events")
    meta = F.concat(F.lit('{"safety":{"status":"'), "event_type", F.lit('"},"stale":true}'))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object(meta, "$.safety.status").alias("status"))


_PACKS = """pk AS (SELECT o_orderkey AS pack_id, list(l_partkey ORDER BY l_linenumber) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
fe AS (SELECT event_id, 1 + event_id % (SELECT max(o_orderkey) FROM orders) AS pack_id, CASE event_type WHEN 'purchase' THEN 'selected' WHEN 'click' THEN 'selected_but_noisy' WHEN 'view' THEN 'irrelevant' WHEN 'error' THEN 'rejected' ELSE 'stale' END AS feedback_type, CASE WHEN event_id % 3 = 0 THEN [event_id % 50, event_id % 7 + 100] ELSE [] END AS rejected, ts FROM events),
st AS (SELECT event_id, unnest(rejected) AS item_id, feedback_type, ts FROM fe WHERE feedback_type IN ('rejected', 'irrelevant', 'stale') UNION ALL
 SELECT event_id, unnest(ids), feedback_type, ts FROM fe JOIN pk ON pk.pack_id = fe.pack_id WHERE feedback_type IN ('selected', 'selected_but_noisy') OR len(rejected) = 0)"""


def _feedback_events(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("pack_id"))
    lines = read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("pack_id")).groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("id")))).alias("l"))
    half = lambda cond: F.transform(F.filter("l", lambda x, i: cond(i)), lambda x: F.struct(x["id"].alias("id")))
    packs = lines.select("pack_id", F.to_json(F.array(F.struct(half(lambda i: i % 2 == 0).alias("items")), F.struct(half(lambda i: i % 2 == 1).alias("items")))).alias("sections"))
    last = o.agg(F.max("pack_id").alias("last"))
    k, e = F.col("event_id"), F.col("event_type")
    kind = F.when(e == "purchase", "selected").when(e == "click", "selected_but_noisy").when(e == "view", "irrelevant").when(e == "error", "rejected").otherwise("stale")
    events = read(spark, d, "events").crossJoin(F.broadcast(last)).select("event_id", (1 + k % F.col("last")).alias("pack_id"), kind.alias("feedback_type"), F.when(k % 3 == 0, F.array(k % 50, k % 7 + 100)).otherwise(F.array().cast("array<bigint>")).alias("rejected"), "ts")
    return events, packs


@query("WITH " + _PACKS + " SELECT event_id, item_id, feedback_type FROM st")
def feedback_streams(spark, d):
    """Feedback on items that events name and on those of their packs."""
    return D.feedback_streams(*_feedback_events(spark, d)).select("event_id", "item_id", "feedback_type")


@query("WITH " + _PACKS + """ SELECT item_id, count(*) FILTER (feedback_type = 'selected') AS n_selected, count(*) FILTER (feedback_type = 'selected_but_noisy') AS n_noisy, count(*) FILTER (feedback_type = 'rejected') AS n_rejected, count(*) FILTER (feedback_type = 'irrelevant') AS n_irrelevant,
 count(*) FILTER (feedback_type = 'stale') AS n_stale, arg_max(feedback_type, (ts, event_id, feedback_type)) AS latest, max(ts) AS latest_at FROM st GROUP BY item_id""")
def pack_feedback_summary(spark, d):
    """The summary of all feedback streams for each item."""
    return R.feedback_summary(D.feedback_streams(*_feedback_events(spark, d)))


@query("""SELECT event_id, feedback_type, coalesce(p.r_name, q.n_name, 'unknown') AS project, pack IS NOT NULL AS in_pack FROM (SELECT event_id, event_type AS feedback_type, event_id % 9 AS region, event_id % 35 AS nation, event_id % 4000 AS pack_id FROM events) e
LEFT JOIN region p ON p.r_regionkey = region LEFT JOIN nation q ON q.n_nationkey = nation LEFT JOIN (SELECT o_orderkey AS pack FROM orders) o ON pack = pack_id""")
def feedback_projects(spark, d):
    """Feedback with its pack and its project: that of the event, else that of the pack, else unknown."""
    k = F.col("event_id")
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("feedback_type"), (k % 9).cast("int").alias("r_regionkey"), (k % 35).cast("int").alias("n_nationkey"), (k % 4000).alias("o_orderkey"))
    j = e.join(read(spark, d, "region"), "r_regionkey", "left").join(read(spark, d, "nation"), "n_nationkey", "left").join(read(spark, d, "orders").select("o_orderkey", F.lit(True).alias("pack")), "o_orderkey", "left")
    return j.select("event_id", "feedback_type", F.coalesce("r_name", "n_name", F.lit("unknown")).alias("project"), F.col("pack").isNotNull().alias("in_pack"))


@query(with_("prompts") + """, r AS (SELECT query_id, [{t: 'file', u: p_name, a: 1, b: 5}, {t: 'file', u: p_name, a: 1, b: 5}, {t: 'file', u: p_name, a: 2, b: NULL}, {t: CASE WHEN query_id % 2 = 0 THEN 'url' ELSE 'file' END, u: p_name, a: 1, b: 5}] AS l FROM prompts)
SELECT query_id, len(list_distinct([x.t || ':' || x.u || ':' || coalesce(x.a::VARCHAR, '') || ':' || coalesce(x.b::VARCHAR, '') FOR x IN l])) AS n FROM r""")
def reference_dedup(spark, d):
    """How many different references each text has, by kind, address and lines."""
    ref = lambda t, a, b: F.struct(t.alias("type"), F.col("p_name").alias("uri"), F.lit(a).alias("line_start"), F.lit(b).cast("int").alias("line_end"))
    file = F.lit("file")
    refs = F.array(ref(file, 1, 5), ref(file, 1, 5), ref(file, 2, None), ref(F.when(F.col("query_id") % 2 == 0, "url").otherwise("file"), 1, 5))
    return prompts(spark, d).select("query_id", F.size(ingest.unique_references(refs)).cast("long").alias("n"))


_NL = r"regexp_replace(regexp_replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), '[^a-z0-9._/-]+', '-', 'g'), '^-|-$', '', 'g')"


@query("SELECT p_partkey, n_nationkey FROM part JOIN nation ON " + _NL.format("CASE p_partkey % 2 WHEN 0 THEN ' Nation ' || p_partkey % 25 ELSE p_brand END") + " = " + _NL.format("'nation  ' || n_nationkey"))
def normalized_join(spark, d):
    """Values that are the same once normalised."""
    k = F.col("p_partkey")
    a = read(spark, d, "part").select("p_partkey", F.when(k % 2 == 0, F.concat(F.lit(" Nation "), (k % 25).cast("string"))).otherwise(F.col("p_brand")).alias("l"))
    b = read(spark, d, "nation").select("n_nationkey", F.concat(F.lit("nation  "), F.col("n_nationkey").cast("string")).alias("r"))
    return D.related(a, b, "l", "r").select("p_partkey", "n_nationkey")


@query(with_("edges") + """, old AS (SELECT src, dst, kind, confidence, CASE WHEN (src + dst) % 2 = 0 THEN 'git' ELSE 'vector' END AS origin FROM edges), fresh AS (SELECT src, dst, CASE WHEN dst % 2 = 0 THEN 'related_to' ELSE 'refines' END AS kind, max(confidence) / 2 AS confidence FROM edges WHERE src % 3 = 0 GROUP BY 1, 2, 3),
n AS (SELECT src, dst, kind, confidence, 'git' AS origin FROM fresh UNION ALL SELECT dst, src, kind, confidence, 'git' FROM fresh WHERE kind IN ('related_to', 'co_changes_with') UNION ALL SELECT * FROM old WHERE origin <> 'git' OR src NOT IN (SELECT src FROM fresh))
SELECT src, dst, kind, origin, max(confidence) AS confidence FROM n GROUP BY 1, 2, 3, 4""")
def edge_replace(spark, d):
    """Edges of one origin put out by fresh ones of the same sources, mirrored where the kind has no direction."""
    e = edges(spark, d)
    old = e.withColumn("origin", F.when((F.col("src") + F.col("dst")) % 2 == 0, "git").otherwise("vector"))
    fresh = e.where("src % 3 = 0").groupBy("src", "dst", F.when(F.col("dst") % 2 == 0, "related_to").otherwise("refines").alias("kind")).agg((F.max("confidence") / 2).alias("confidence"))
    return D.replaced_edges(old, fresh, "git")


_OLD = "o AS (SELECT src, dst, kind, (src + dst) % 3 = 0 AS inferred FROM edges)"


@query(with_("edges") + f""", {_OLD}, c AS (SELECT DISTINCT dst AS src, src AS dst, 'supersedes' AS kind FROM edges WHERE dst % 10 = 0 AND src % 10 = 0)
SELECT src, dst, kind, inferred, NULL::TIMESTAMP AS valid_from, CASE WHEN inferred AND src IN (SELECT dst FROM c) THEN TIMESTAMP '{AS_OF}' END AS valid_until FROM o UNION ALL SELECT src, dst, kind, FALSE, TIMESTAMP '{AS_OF}', NULL FROM c""")
def relation_create(spark, d):
    """Relations after superseding ones were added: inferred ones out of the superseded end."""
    e = edges(spark, d).select("src", "dst", "kind", ((F.col("src") + F.col("dst")) % 3 == 0).alias("inferred"))
    old = e.withColumns({"valid_from": F.lit(None).cast("timestamp"), "valid_until": F.lit(None).cast("timestamp")})
    new = edges(spark, d).where("dst % 10 = 0 AND src % 10 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().select("src", "dst", F.lit("supersedes").alias("kind"), F.lit(False).alias("inferred"))
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return D.with_relation(old, new, AS_OF).select("src", "dst", "kind", "inferred", naive("valid_from"), naive("valid_until"))


@query(with_("atoms", "edges") + f", {_OLD} SELECT src, dst, kind, inferred FROM o WHERE NOT inferred OR src NOT IN (SELECT atom_id FROM atoms WHERE status <> 'active')")
def status_change(spark, d):
    """Relations left after items lost their approval."""
    e = edges(spark, d).select("src", "dst", "kind", ((F.col("src") + F.col("dst")) % 3 == 0).alias("inferred"))
    return D.after_status(e, atoms(spark, d).select(F.col("atom_id").alias("item_id"), F.when(F.col("status") == "active", "approved").otherwise("archived").alias("status")))


@query(_KB + " SELECT item_id, type, value, weight, source, confidence FROM kl")
def label_provenance(spark, d):
    """Labels after a round trip through the map of provenance in metadata."""
    return D.rehydrated(D.provenance(K.labels(spark, d)))


@query(with_("atoms") + f" SELECT atom_id, CASE WHEN status = 'archived' AND atom_id % 2 = 0 THEN 'active' ELSE status END AS status, CASE WHEN status = 'archived' AND atom_id % 2 = 0 THEN TIMESTAMP '{AS_OF}' ELSE last_reused END AS last_reused FROM atoms")
def atom_resurrect(spark, d):
    a = atoms(spark, d).select("atom_id", "status", "last_reused")
    return D.resurrected(a, a.where("atom_id % 2 = 0").select("atom_id"), AS_OF)


@query("""WITH t AS (SELECT p_partkey AS item_id, unnest(regexp_extract_all(lower(p_name), '[a-z0-9_./:-]+')) AS token FROM part WHERE p_partkey % 3 = 0), h AS (SELECT item_id, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 64 AS slot, CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM t),
s AS (SELECT item_id, slot, sum(sign)::DOUBLE AS x FROM h GROUP BY 1, 2), n AS (SELECT item_id, slot, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM s WHERE x <> 0) SELECT item_id, slot::INT AS slot, round(w, 6) AS weight FROM n""")
def reembed_backfill(spark, d):
    """Nonzero entries of the vectors made for texts that had none."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 3 != 0, F.array(F.lit(1.0))).alias("vector"))
    return D.backfill(p, 64, 16).select("item_id", F.posexplode("vector").alias("slot", "weight")).where("weight <> 0")


_AREA_PATH = "CASE WHEN p_partkey % 9 = 0 THEN 'README.md' ELSE 'src/' || split_part(p_name, ' ', 1) || '/' || p_partkey || '.md' END"


@query(f"SELECT CASE WHEN p_partkey % 9 = 0 THEN '_root' ELSE 'src/' || split_part(p_name, ' ', 1) END AS area, count(*) AS n, sha256(string_agg(p_partkey || ' ' || sha256(p_type), chr(10) ORDER BY p_partkey)) AS digest FROM part GROUP BY 1")
def area_packs(spark, d):
    """Exported packs by area, as digests of their lines."""
    k = F.col("p_partkey")
    path = F.when(k % 9 == 0, "README.md").otherwise(F.concat(F.lit("src/"), F.element_at(F.split("p_name", " "), 1), F.lit("/"), k.cast("string"), F.lit(".md")))
    return D.area_packs(read(spark, d, "part").select(k.alias("item_id"), path.alias("path"), F.col("p_type").alias("content")))


@query("WITH " + K.KB + r" SELECT project || '/' || item_type || '/' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-' || item_id || '.md' AS path, sha256('---' || chr(10) || 'id: ' || item_id || chr(10) || 'type: ' || item_type || chr(10) || '---' || chr(10) || '# ' || title || chr(10) || chr(10) || content || chr(10)) AS digest FROM kb")
def markdown_mirror(spark, d):
    return D.mirror(K.kb(spark, d))


@query(r"SELECT path, status, prior, similarity FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'new/' || p_partkey WHEN 1 THEN 'b/' || p_partkey ELSE 'a/' || p_partkey END AS path, CASE p_partkey % 5 WHEN 0 THEN 'renamed' WHEN 1 THEN 'added' WHEN 2 THEN 'added' WHEN 3 THEN 'deleted' ELSE 'changed' END AS status, CASE WHEN p_partkey % 5 = 0 THEN 'old/' || p_partkey END AS prior, CASE p_partkey % 5 WHEN 0 THEN (80 + p_partkey % 20)::INT WHEN 1 THEN 75 END AS similarity FROM part)")
def git_diff(spark, d):
    """Records of a diff between commits, parsed."""
    k = F.col("p_partkey")
    n = k.cast("string")
    zero = F.lit("\x00")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("R0"), (80 + k % 20).cast("string"), zero, F.lit("old/"), n, zero, F.lit("new/"), n, zero)).when(k % 5 == 1, F.concat(F.lit("C075"), zero, F.lit("a/"), n, zero, F.lit("b/"), n, zero))
        .when(k % 5 == 2, F.concat(F.lit("A"), zero, F.lit("a/"), n, zero)).when(k % 5 == 3, F.concat(F.lit("D"), zero, F.lit("a/"), n, zero)).otherwise(F.concat(F.lit("M"), zero, F.lit("a/"), n, zero))
    )
    return D.git_files(read(spark, d, "part").select(line.alias("line")))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}'))), ',') || '|' || array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(t), '\b[a-z][a-z0-9]*(?:[-_][a-z0-9]+)+\b'), lambda x: length(x) >= 5))), ',') || '|'
 || array_to_string(list_sort(list_distinct([x[2:-2] FOR x IN regexp_extract_all(t, '"[^"]{3,80}"|''[^'']{3,80}''')])), ',') AS found FROM (SELECT doc_id, '"quoted ' || lang || '" pre-fix_' || lang || ' 0f8fad5b-d9cb-469f-a165-' || lpad(doc_id::VARCHAR, 12, '0') || ' ' || source AS t FROM documents)""")
def hints(spark, d):
    """Ids, compounds and quoted terms of texts."""
    t = F.concat(F.lit('"quoted '), "lang", F.lit('" pre-fix_'), "lang", F.lit(" 0f8fad5b-d9cb-469f-a165-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(" "), "source")
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return read(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.concat_ws("|", joined(T.uuids(F.col("t"))), joined(T.compounds(F.col("t"))), joined(T.quoted(F.col("t")))).alias("found"))


_PATHS = "CASE page_id % 5 WHEN 0 THEN 'src/a' || page_id || '.ts' WHEN 1 THEN 'x/docs/b.txt' WHEN 2 THEN 'Requirements/c.txt' WHEN 3 THEN 'my-spec.py' ELSE 'README.MD' END"


@query(f"SELECT page_id, CASE WHEN lower(p) LIKE '%.md' OR contains(lower(p), '/docs/') OR contains(lower(p), '/wiki/') THEN 'wiki' WHEN contains(lower(p), 'spec') OR contains(lower(p), 'requirements') THEN 'spec' ELSE 'code_ref' END AS item_type FROM (SELECT page_id, {_PATHS} AS p FROM pages)")
def item_type_of_path(spark, d):
    k = F.col("page_id")
    p = F.when(k % 5 == 0, F.concat(F.lit("src/a"), k.cast("string"), F.lit(".ts"))).when(k % 5 == 1, "x/docs/b.txt").when(k % 5 == 2, "Requirements/c.txt").when(k % 5 == 3, "my-spec.py").otherwise("README.MD")
    return read(spark, d, "pages").select("page_id", signals.item_type_of_path(p).alias("item_type"))


@query(with_("prompts") + " SELECT query_id, p_name || ' / ' || p_brand AS a, upper(p_name) || '  /' || lower(p_brand) AS b, " + _NL.format("p_name || ' / ' || p_brand") + " = " + _NL.format("upper(p_name) || '  /' || lower(p_brand)") + " AS same FROM prompts")
def same_signals(spark, d):
    a, b = F.concat("p_name", F.lit(" / "), "p_brand"), F.concat(F.upper("p_name"), F.lit("  /"), F.lower("p_brand"))
    return prompts(spark, d).select("query_id", a.alias("a"), b.alias("b"), T.same_signal(a, b).alias("same"))


@query("""WITH RECURSIVE c AS (SELECT doc_id, text AS t, 0 AS n FROM documents WHERE strlen(text) > 1000 UNION ALL SELECT doc_id, substr(t, 1, floor(length(t) * 0.8)::INT), n + 1 FROM c WHERE strlen(t) > 988),
e AS (SELECT doc_id, arg_max(t, n) AS t FROM c GROUP BY 1) SELECT d.doc_id, sha256(CASE WHEN e.t IS NULL THEN text ELSE e.t || chr(10) || '[truncated]' END) AS digest FROM (SELECT * FROM documents WHERE text IS NOT NULL) d LEFT JOIN e ON e.doc_id = d.doc_id""")
def utf8_truncate(spark, d):
    """Texts cut to 1,000 bytes of UTF-8."""
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(T.truncate_utf8(F.col("text"), 1000), 256).alias("digest"))


_LINE_STATUS = "CASE l_linenumber % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'R' || l_suppkey % 100 WHEN 3 THEN 'D' ELSE 'C50' END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_LINE_STATUS} AS status, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nr, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey AS commit_id, 'src/f' || l_partkey || '.ts' AS path, CASE WHEN status = 'A' OR status = 'C50' THEN 'added' WHEN status = 'D' THEN 'deleted' WHEN status[1] = 'R' THEN 'renamed' ELSE 'modified' END AS status,
 CASE WHEN status[1] = 'R' THEN 'old/f' || l_suppkey || '.ts' END AS prior, CASE WHEN status[1] = 'R' THEN CASE WHEN l_suppkey % 100 = 0 THEN 100 ELSE l_suppkey % 100 END END::INT AS similarity, FALSE AS malformed FROM l
UNION ALL SELECT DISTINCT l_orderkey, 'R77 cut/' || l_orderkey, NULL, NULL, NULL::INT, TRUE FROM lineitem WHERE l_orderkey % 11 = 0""")
def diff_records(spark, d):
    """Every order's lines as a diff with zero bytes, a few of them cut short, read back into records."""
    from ..sources import readers

    n, s = F.col("l_linenumber") % 5, F.col("l_suppkey").cast("string")
    path, old, zero = F.concat(F.lit("src/f"), F.col("l_partkey").cast("string"), F.lit(".ts")), F.concat(F.lit("old/f"), s, F.lit(".ts")), F.lit("\x00")
    text = F.when(n == 0, F.concat(F.lit("A"), zero, path)).when(n == 1, F.concat(F.lit("M"), zero, path)).when(n == 2, F.concat(F.lit("R"), (F.col("l_suppkey") % 100).cast("string"), zero, old, zero, path)).when(n == 3, F.concat(F.lit("D"), zero, path)).otherwise(F.concat(F.lit("C50"), zero, old, zero, path))
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", text.alias("t")).alias("x"))
    whole = lines.groupBy("commit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x["t"], zero)), "").alias("text"))  # an order's lines are few
    cut_short = F.when(F.col("commit_id") % 11 == 0, F.concat(F.lit("R77\x00cut/"), F.col("commit_id").cast("string"), zero)).otherwise("")
    return whole.select("commit_id", F.explode(readers.diff_records(F.concat("text", cut_short))).alias("r")).select("commit_id", "r.*")


@query("""SELECT event_type AS category, event_id % 10 = 3 OR event_id % 10 = 7 AS malformed, count(*) AS n, sum(CASE WHEN event_id % 10 IN (3, 7) THEN NULL ELSE event_id % 5 END)::BIGINT AS severity FROM events WHERE event_id % 10 <> 3 GROUP BY 1, 2
UNION ALL SELECT NULL, TRUE, count(*), NULL FROM events WHERE event_id % 10 = 3 HAVING count(*) > 0""")
def incident_files(spark, d):
    """Incidents written as lines of JSON, some broken and some without an id, read back and counted."""
    from ..sources import readers
    from ..sources.shared import shared_dir

    k = F.col("event_id")
    line = F.to_json(F.struct(F.when(k % 10 != 7, k.cast("string")).alias("id"), F.col("event_type").alias("category"), (k % 5).cast("int").alias("severity"), F.lit("down").alias("message"), F.lit(1).alias("occurrences"), "ts"))
    path = f"{shared_dir(spark)}/heronry-incidents-{uuid.uuid4().hex}"
    read(spark, d, "events").select(F.when(k % 10 == 3, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    rows = readers.incidents(spark, path, lines=True)
    return rows.groupBy("category", "malformed").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("malformed"), F.col("severity"))).alias("severity"))


_KEY = "'ghp_' || substr(sha256(atom_id::VARCHAR), 1, 24)"
_CLEAN = lambda c: f"regexp_replace({c}, '\\bghp_[A-Za-z0-9_]{{20,}}\\b', '[REDACTED:secret]', 'g')"


@query(with_("atoms") + f""", f AS (SELECT atom_id, claim || CASE atom_id % 5 WHEN 0 THEN ' by ' || {_KEY} ELSE '' END AS claim, [CASE atom_id % 5 WHEN 1 THEN {_KEY} ELSE 'test' END, 'seen'] AS evidence, symbols || [CASE atom_id % 5 WHEN 2 THEN 'x=' || {_KEY} || ';' ELSE 'none' END] AS triggers, CASE atom_id % 5 WHEN 3 THEN [{_KEY}, {_KEY} || 'Z!'] ELSE [] END AS pitfalls FROM atoms)
SELECT atom_id, {_CLEAN("claim")} AS claim, array_to_string([{_CLEAN("x")} FOR x IN evidence], '|') AS evidence, array_to_string([{_CLEAN("x")} FOR x IN triggers], '|') AS triggers, array_to_string([{_CLEAN("x")} FOR x IN pitfalls], '|') AS pitfalls FROM f""")
def redacted_facts(spark, d):
    """Facts with a token in the claim, the evidence, a trigger or the pitfalls, which is taken out wherever it stands."""
    k = F.col("atom_id")
    key = F.concat(F.lit("ghp_"), F.substring(F.sha2(k.cast("string"), 256), 1, 24))
    rows = atoms(spark, d).select(
        "atom_id", F.concat("claim", F.when(k % 5 == 0, F.concat(F.lit(" by "), key)).otherwise("")).alias("claim"), F.array(F.when(k % 5 == 1, key).otherwise("test"), F.lit("seen")).alias("evidence"),
        F.array_append("symbols", F.when(k % 5 == 2, F.concat(F.lit("x="), key, F.lit(";"))).otherwise("none")).alias("triggers"), F.when(k % 5 == 3, F.array(key, F.concat(key, F.lit("Z!")))).otherwise(F.array().cast("array<string>")).alias("pitfalls"),
    )
    return D.redacted_atoms(rows).select("atom_id", "claim", *[F.array_join(c, "|").alias(c) for c in ("evidence", "triggers", "pitfalls")])

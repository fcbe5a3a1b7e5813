"""From the texts of the knowledge base to packs: ingestion, four searches, merge, rerank, adjustments, fit, acceptance, caps, sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..functions import text as T
from ..operators import context as C
from ..operators import ingest
from ..operators import ranking as R
from ..operators import search as S
from ..operators import sessions
from ..operators import signals
from ..sources.shared import cut
from . import kb as K
from .bridge import AS_OF, CTE, atoms, edges, feedback, prompts, read, with_
from .ranking_queries import _ADJUST, _FACTOR, _STALE, SUMMARY
from .registry import query
from .search_queries import RELATION_SQL, terms_sql

_TREE_SQL = """tf AS (SELECT o_custkey AS query_id, 'src/f' || o_orderkey % 40 || '.ts' AS path, CASE o_orderkey % 4 WHEN 0 THEN 'prompt_named' WHEN 1 THEN 'git_changed' WHEN 2 THEN 'handoff' ELSE 'recent' END AS reason, o_orderdate AS modified FROM orders),
ts AS (SELECT query_id, path, reason, CASE reason WHEN 'prompt_named' THEN 1.0 WHEN 'git_changed' THEN 0.85 WHEN 'handoff' THEN 0.75 ELSE 0.6 END::DOUBLE AS score, max(modified) AS modified FROM tf GROUP BY ALL),
tb2 AS (SELECT * FROM ts QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC) = 1), tk AS (SELECT * FROM tb2 QUALIFY row_number() OVER (PARTITION BY query_id, reason ORDER BY modified DESC, path) <= 5),
tree AS (SELECT query_id, path, score FROM tk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, modified DESC, path) <= 18)"""
ORDER = ("metadata", "lexical", "memory", "vector", "graph", "worktree", "atoms", "userStyle", "convention")
#: Ids of files of the work tree: this, less the number of the file.
TREE = -1_000_000_000


@query("WITH " + K.KB + ",\n" + K.GIVEN + " SELECT item_id, type, value, weight, confidence FROM given")
def classification_labels(spark, d):
    """Labels that the classification of every text gives."""
    return ingest.classifier_labels(K.classified(spark, d), "item_id").select("item_id", "type", "value", "weight", "confidence")


@query("WITH " + K.KB + ",\n" + K.LABELS + " SELECT * FROM kl")
def enriched_labels(spark, d):
    """Labels of every text, inferred ones merged with those of users."""
    return K.labels(spark, d)


_INTENT = "CASE item_id % 7 WHEN 0 THEN ' and resume the current work' WHEN 1 THEN ' with the reflection drafts' WHEN 2 THEN ' for the ops queues' WHEN 3 THEN ' of context quality' WHEN 4 THEN ' after a lesson learned' ELSE '' END"


@query("WITH " + K.KB.replace("prompt AS content", f"prompt || {_INTENT.replace('item_id', 'query_id')} AS content") + f""" SELECT item_id AS query_id, {K.STAGE} AS stage, {K.MODE} AS mode, array_to_string(list_sort(list_distinct({K.REQUIRED})), ',') AS required,
 array_to_string(list_filter([CASE WHEN project IS NULL THEN 'project is unclear' END, CASE WHEN task = 'unknown' THEN 'task type is unclear' END, CASE WHEN len(files) + len(symbols) + len(errors) = 0 THEN 'no concrete file, symbol, or error signal was supplied' END,
 CASE WHEN continuation THEN 'continuation prompt relies on handoff or recent selected-session context' END], lambda x: x IS NOT NULL), ';') AS uncertain FROM (SELECT *, regexp_matches({K._LOW}, '{P.CONTINUATION_PATTERN}') AS continuation FROM kc)""")
def query_intent(spark, d):
    """Stage, mode, evidence asked for and doubts of every prompt, most of them with a phrase of a fixed list behind."""
    k = F.col("item_id")
    more = F.when(k % 7 == 0, " and resume the current work").when(k % 7 == 1, " with the reflection drafts").when(k % 7 == 2, " for the ops queues").when(k % 7 == 3, " of context quality").when(k % 7 == 4, " after a lesson learned").otherwise("")
    i = signals.intent(signals.classify(K.kb(spark, d).withColumn("prompt", F.concat("content", more))))
    return i.select(k.alias("query_id"), "stage", "mode", F.array_join(F.sort_array("required"), ",").alias("required"), F.array_join("uncertain", ";").alias("uncertain"))


_KINDS = {
    "files": (P.FILE_PATTERN, True, P.SWEEP_CAPS["files"]), "symbols": (P.SWEEP_SYMBOL, True, P.SWEEP_CAPS["symbols"]), "errors": (P.SWEEP_ERROR, True, P.SWEEP_CAPS["errors"]),
    "technologies": (rf"\b(?:{'|'.join(P.SWEEP_TECHNOLOGIES)})\b", False, P.SWEEP_CAPS["technologies"]), "areas": (rf"\b(?:{'|'.join(P.BUSINESS_AREAS)})\b", False, P.SWEEP_CAPS["areas"]),
}


def _located(pattern: str, text: str) -> str:
    """SQL rows of query_id, value, pos (offset) of all matches."""
    return f"""(SELECT query_id, hits[i] AS value, (list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0))::INT AS pos
 FROM (SELECT query_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT query_id, regexp_extract_all({text}, '{pattern}') AS hits, string_split_regex({text}, '{pattern}') AS gaps FROM st)))"""


_SWEPT = "prompt || CASE query_id % 3 WHEN 0 THEN ' ' || prompt WHEN 1 THEN ' in `src/' || query_id || '.ts` and ```' || chr(10) || 'callHandler(' || query_id || ') // ERR-77' || query_id || chr(10) || '```' ELSE '' END"


@query(with_("prompts") + f""", st AS (SELECT query_id, {_SWEPT} AS prompt FROM prompts), fences AS {_located(P.CODE_PATTERN, "prompt")},
each AS ({" UNION ALL ".join(f"SELECT query_id, '{k}' AS kind, {str(free).lower()} AS free, {most} AS most, value, pos FROM {_located(p, 'prompt' if free else 'lower(prompt)')}" for k, (p, free, most) in _KINDS.items())}),
fl AS (SELECT e.*, EXISTS (SELECT 1 FROM fences f WHERE f.query_id = e.query_id AND f.pos <= e.pos AND e.pos < f.pos + length(f.value)) AS code, regexp_matches(lower(substr(prompt, greatest(0, e.pos - 50) + 1, e.pos + 50 - greatest(0, e.pos - 50))), '\\b(?:{"|".join(P.SWEEP_VERBS)})\\b') AS verb FROM each e JOIN st ON st.query_id = e.query_id),
sc AS (SELECT query_id, kind, free, most, value, max(code) AS code, max(verb) AS verb, round(least(1, least(1, ln(1 + count(*)) / ln(9)) + CASE WHEN max(code) THEN 0.3 ELSE 0 END + CASE WHEN max(verb) THEN 0.2 ELSE 0 END), 6) AS score FROM fl GROUP BY 1, 2, 3, 4, 5)
SELECT query_id, kind, value, score, code, verb FROM sc WHERE score >= 0.25 AND (NOT free OR code OR verb) QUALIFY row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, value) <= most""")
def signal_sweep(spark, d):
    """Scored signals of every prompt, a third of them twice as long, a third with code behind."""
    k = F.col("query_id")
    code = F.concat(F.lit(" in `src/"), k.cast("string"), F.lit(".ts` and ```\ncallHandler("), k.cast("string"), F.lit(") // ERR-77"), k.cast("string"), F.lit("\n```"))
    p = prompts(spark, d)
    return signals.sweep(p.select("query_id", F.concat("prompt", F.when(k % 3 == 0, F.concat(F.lit(" "), "prompt")).when(k % 3 == 1, code).otherwise("")).alias("prompt")), _KINDS)


# --- the way from search to pack: each step is a table of its own, and SQL of the same name ---


def _facts(spark, d):
    """Facts with project, scope (user's, team's, project's, none), trigger keys and priority."""
    k = F.col("atom_id")
    scope = F.when(k % 4 == 1, "team").when(k % 4 == 2, "project").when(k % 3 == 0, "user")
    return atoms(spark, d).withColumns({"project": F.concat(F.lit("p"), (F.col("p_size") % 5).cast("string")), "scope_of": scope, "keys": F.concat("symbols", "words"), "priority": F.when(k % 5 == 0, "personal_workflow").otherwise("coding_preference")})


def _tree(spark, d):
    """Live files of each query: customers' orders as files touched, with the reason they count."""
    o = read(spark, d, "orders")
    reason = F.when(F.col("o_orderkey") % 4 == 0, "prompt_named").when(F.col("o_orderkey") % 4 == 1, "git_changed").when(F.col("o_orderkey") % 4 == 2, "handoff").otherwise("recent")
    f = o.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("src/f"), (F.col("o_orderkey") % 40).cast("string"), F.lit(".ts")).alias("path"), reason.alias("reason"), F.col("o_orderdate").alias("modified"))
    return f.groupBy("query_id", "path", "reason").agg(F.max("modified").alias("modified"))


def _items(spark, d, labels):
    """Attributes of all that searches find: items, facts under negative ids, and files of the work tree below TREE."""
    gathered = labels.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("type", "value", "confidence", "source"))).alias("labels"))
    i = K.kb(spark, d).join(gathered, "item_id", "left")
    a = _facts(spark, d).select(
        (-F.col("atom_id")).alias("item_id"), "project", F.lit("memory").alias("item_type"), F.col("claim").alias("title"), F.lit("").alias("summary"), F.col("claim").alias("content"), "tier", "priority",
        F.when(F.col("status") == "active", "approved").otherwise("archived").alias("status"), F.lit(60).alias("trust"),
    )
    path = F.concat(F.lit("src/f"), F.col("n").cast("string"), F.lit(".ts"))
    t = read(spark, d, "orders").select((F.col("o_orderkey") % 40).alias("n")).distinct().select((F.lit(TREE) - F.col("n")).alias("item_id"), F.lit("code_ref").alias("item_type"), path.alias("title"), F.lit("").alias("summary"), path.alias("content"), F.lit("approved").alias("status"), F.lit(90).alias("trust"))
    rows = i.unionByName(a, allowMissingColumns=True).unionByName(t, allowMissingColumns=True)
    return rows.withColumn("labels", F.coalesce("labels", F.array().cast("array<struct<type:string,value:string,confidence:double,source:string>>")))


def _rejected(queries, spark, d):
    """Items and facts that a query has rejected before: errors of the users that stand for it."""
    n = read(spark, d, "part").agg(F.count("*").alias("n"))
    e = read(spark, d, "events").where("event_type = 'error'").crossJoin(F.broadcast(n))
    item = (F.col("event_id") % F.col("n") + 1) * F.when(F.col("event_id") % 2 == 0, -1).otherwise(1)
    rows = e.select((F.col("user_id") % F.greatest(F.lit(1), F.floor(F.col("n") / 100)) * 100 + 100).alias("query_id"), item.alias("item_id")).distinct()
    return cut(rows.join(queries.select("query_id"), "query_id", "left_semi"))


def _hits(spark, d, q, labels, items):
    """Hits of nine sources; project and rejections count before each source's best are chosen."""
    rejected = _rejected(q, spark, d)
    wanted = q.select("query_id", "wanted_project")
    allowed = lambda hits: C.eligible(hits, items, rejected, wanted)
    signal = lambda t, p: lambda v: F.struct(F.lit(t).alias("type"), v.alias("value"), F.lit(p).alias("precise"))
    named = [F.transform(c, signal(t, p)) for c, t, p in (("files", "file", True), ("symbols", "symbol", True), ("errors", "error", True), ("technologies", "technology", False), ("areas", "business_area", False))]
    signals_of = q.select("query_id", F.col("wanted_project").alias("wanted"), F.explode(F.concat(*named)).alias("s")).select("query_id", "wanted", "s.*")
    approved = K.kb(spark, d).where("status = 'approved'")
    found = labels.join(approved.select("item_id", "trust", "fresh_on", "project"), "item_id").select("item_id", "type", "value", "trust", "fresh_on", "project")
    metadata = S.by_label(signals_of, found, rejected=rejected)
    exact = F.concat("files", "symbols", "errors", "technologies", "areas", T.compounds(F.col("prompt")))
    no = rejected.groupBy("query_id").agg(F.collect_list("item_id").alias("rejected"))  # of a query, few
    terms = q.join(no, "query_id", "left").select("query_id", F.slice(F.array_distinct(F.transform(T.lexical_terms(F.col("prompt"), exact, 1 << 20), F.lower)), 1, 32).alias("terms"), F.col("wanted_project").alias("wanted"), "rejected")
    texts = approved.select("item_id", "item_type", "project", F.concat_ws(" ", "title", "summary", "content").alias("content"))
    lexical, memory = S.lexical(terms, texts, group="project"), S.memory(terms, texts, group="project")
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = v.withColumnRenamed("item_id", "query_id").join(terms.select("query_id", "wanted", "rejected"), "query_id")
    vector = S.vector(asked, v.join(approved.select("item_id", F.col("project").alias("g")), "item_id"))
    direct = cut(metadata.unionByName(lexical).unionByName(memory).unionByName(vector))
    graph = S.graph(direct.select("query_id", "item_id").distinct(), edges(spark, d), direct.limit(0), allowed=allowed)
    place = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("nr", "item_id")))
    tree = sessions.worktree(_tree(spark, d).join(q.select("query_id"), "query_id", "left_semi"), P.SEARCH_LIMIT)
    tree = place(tree.select("query_id", F.lit("worktree").alias("source"), (F.lit(TREE) - F.regexp_extract("path", r"(\d+)", 1).cast("int")).alias("item_id"), F.col("score").alias("raw"), (-F.col("score")).alias("nr"))).drop("nr")
    keys = q.join(prompts(spark, d), "query_id").select("query_id", F.array(F.lower("p_brand"), F.element_at(F.split("p_name", " "), 1)).alias("keys"), F.col("wanted_project").alias("wanted"))
    facts = _facts(spark, d)

    def lane(hits, source, raw, nr=F.lit(0)):
        return hits.select("query_id", F.lit(source).alias("source"), (-F.col("atom_id")).alias("item_id"), F.lit(raw).alias("raw"), (nr * 100 + F.col("rank")).alias("nr"), "atom_id")

    scope = lambda name: facts.where(F.col("scope_of") == name)
    atom = lane(S.by_trigger(keys, facts), "atoms", 1.0)
    style = lane(S.by_trigger(keys.drop("wanted"), scope("user")), "userStyle", 1.0)
    # Only facts that are conventions count, but they are told apart after each scope's best are chosen.
    team = lane(S.by_trigger(keys.drop("wanted"), scope("team")), "convention", 1.1).unionByName(lane(S.by_trigger(keys, scope("project")), "convention", 1.1, F.lit(1))).where("atom_id % 7 <> 0")
    lanes = [place(rows.drop("atom_id").join(rejected, ["query_id", "item_id"], "left_anti")).drop("nr") for rows in (atom, style, team)]
    return reduce(DataFrame.unionByName, [direct, graph, tree, *lanes])


def _merged(spark, d):
    q, labels = cut(K.queries(spark, d)), cut(K.labels(spark, d))
    items = cut(_items(spark, d, labels))
    hits = _hits(spark, d, q, labels, items)
    hard = (F.size("files") + F.size("symbols") + F.size("errors") > 0).alias("hard")
    slim = hits.join(q.select("query_id", "task", hard), "query_id").join(items.select("item_id", "item_type", "labels"), "item_id").withColumn("item_type", _type_of())
    weight = R.source_weight(F.col("source"), F.col("task"), F.col("hard"), F.col("item_type"), C.label_confidence(F.col("labels"), F.col("task")))
    factor = R.feedback_summary(feedback(spark, d)).select("item_id", F.round(R.feedback_factor(AS_OF), 6).alias("factor"))
    return cut(C.merged(slim, weight, ORDER, factor)), q, items


def _type_of():
    return F.when(F.col("source") == "convention", "rule").otherwise(F.col("item_type"))


def _described(spark, d):
    merged, q, items = _merged(spark, d)
    return C.described(merged.join(q, "query_id").join(items, "item_id").withColumn("item_type", _type_of()))


def _adjusted(spark, d):
    rows = C.reranked(_described(spark, d))
    summary = R.feedback_summary(feedback(spark, d)).select("item_id", "n_selected", "n_noisy", "n_stale", "n_rejected", "n_irrelevant", "latest")
    superseded = edges(spark, d).where("kind = 'supersedes'").groupBy(F.col("dst").alias("item_id")).agg(F.max("confidence").alias("superseded"))
    rows = rows.join(summary, "item_id", "left").join(superseded, "item_id", "left")
    return C.adjusted(rows, AS_OF)


def _fitted(spark, d):
    return cut(C.fitted(_adjusted(spark, d), AS_OF))


def _capped(spark, d):
    """Rows of evidence after the caps, and the aggregate fit of each query."""
    rows = _fitted(spark, d)
    return sessions.capped(C.evidence(C.accepted(rows)), P.CATEGORY_CAPS), C.aggregate_fit(rows, F.col("strict")), C.evidence(C.accepted(rows))


_DELTAS = [(t, s, v) for t, x in P.TASK_WEIGHTS.items() for s, v in x.items()]
_VALUES = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in rows) + ")"
_KINDS_SQL = (("files", "file", "true"), ("symbols", "symbol", "true"), ("errors", "error", "true"), ("technologies", "technology", "false"), ("areas", "business_area", "false"))
_NORM = lambda c: rf"regexp_replace(regexp_replace(lower(trim(regexp_replace({c}, '\s+', ' ', 'g'))), '[^a-z0-9._/-]+', '-', 'g'), '^-|-$', '', 'g')"
_ITEMS = f"""lab AS (SELECT item_id, list_sort(list({{type: type, value: value, confidence: confidence, source: source}})) AS labels FROM kl GROUP BY item_id),
fa AS (SELECT *, 'p' || p_size % 5 AS project, CASE WHEN atom_id % 4 = 1 THEN 'team' WHEN atom_id % 4 = 2 THEN 'project' WHEN atom_id % 3 = 0 THEN 'user' END AS scope_of, CASE WHEN atom_id % 5 = 0 THEN 'personal_workflow' ELSE 'coding_preference' END AS priority FROM atoms),
it AS (SELECT kb.*, NULL::VARCHAR AS tier, NULL::VARCHAR AS priority, coalesce(labels, []) AS labels FROM kb LEFT JOIN lab ON lab.item_id = kb.item_id UNION ALL
 SELECT -atom_id, project, 'memory', claim, '', claim, CASE WHEN status = 'active' THEN 'approved' ELSE 'archived' END, 60, NULL, NULL, NULL, tier, priority, [] FROM fa UNION ALL
 SELECT DISTINCT {TREE} - o_orderkey % 40, NULL, 'code_ref', 'src/f' || o_orderkey % 40 || '.ts', '', 'src/f' || o_orderkey % 40 || '.ts', 'approved', 90, NULL, NULL, NULL, NULL, NULL, [] FROM orders),
rj AS (SELECT DISTINCT (user_id % greatest(1, n // 100)) * 100 + 100 AS query_id, (event_id % n + 1) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END AS item_id FROM events, (SELECT count(*) AS n FROM part) WHERE event_type = 'error'),
ok AS (SELECT cq.query_id, it.item_id FROM cq JOIN it ON it.status = 'approved' AND (cq.wanted_project IS NULL OR it.project = cq.wanted_project) WHERE NOT EXISTS (SELECT 1 FROM rj WHERE rj.query_id = cq.query_id AND rj.item_id = it.item_id))"""
_TRIGGERED = lambda name, source, raw, where, plus: f"""{name}0 AS (SELECT a0.query_id, -atom_id AS item_id, {plus} * 100 + row_number() OVER (PARTITION BY a0.query_id ORDER BY CASE tier WHEN 'canonical' THEN 3 WHEN 'verified' THEN 2 ELSE 1 END DESC, last_reused DESC NULLS LAST, atom_id) AS nr
 FROM a0 JOIN fa ON list_contains(symbols, brand) OR list_contains(words, word) WHERE status = 'active' AND {where} QUALIFY nr <= {plus} * 100 + 18)"""  # noqa: E731
_PLACED = lambda name, source, raw, rows: f"{name} AS (SELECT query_id, '{source}' AS source, item_id, {raw}::DOUBLE AS raw, row_number() OVER (PARTITION BY query_id ORDER BY nr, item_id) AS rank FROM ({rows}) r WHERE NOT EXISTS (SELECT 1 FROM rj WHERE rj.query_id = r.query_id AND rj.item_id = r.item_id))"
_OWN = "(wanted_project IS NULL OR fa.project = wanted_project)"
_HITS = f"""sg AS ({" UNION ALL ".join(f"SELECT query_id, '{t}' AS type, unnest({c}) AS value, {p} AS precise FROM cq" for c, t, p in _KINDS_SQL)}),
m0 AS (SELECT sg.query_id, kl.item_id, trust, fresh_on, max(CASE WHEN precise THEN 0.94 ELSE 0.82 END)::DOUBLE AS raw FROM sg JOIN kl ON kl.type = sg.type AND kl.value = sg.value JOIN kb ON kb.item_id = kl.item_id JOIN ok ON ok.query_id = sg.query_id AND ok.item_id = kl.item_id GROUP BY 1, 2, 3, 4),
m1 AS (SELECT query_id, 'metadata' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, trust DESC, fresh_on DESC NULLS LAST, item_id) AS rank FROM m0 QUALIFY rank <= 18),
x0 AS (SELECT query_id, [lower(x) FOR x IN files || symbols || errors || {terms_sql("prompt")}] AS l FROM cq), x1 AS (SELECT query_id, (list_filter(l, lambda x, i: list_position(l, x) = i))[1:32] AS terms FROM x0),
x2 AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM x1), x3 AS (SELECT item_id, item_type, lower(title || ' ' || summary || ' ' || content) AS low FROM kb WHERE status = 'approved'),
x4 AS (SELECT x2.query_id, x3.item_id, item_type, round(count(*) / n_terms, 6) AS raw FROM x2 JOIN x3 ON contains(low, term) JOIN ok ON ok.query_id = x2.query_id AND ok.item_id = x3.item_id GROUP BY x2.query_id, x3.item_id, item_type, n_terms),
x5 AS (SELECT query_id, 'lexical' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM x4 QUALIFY rank <= 18),
x6 AS (SELECT query_id, 'memory' AS source, item_id, raw + 0.15 AS raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM x4 WHERE item_type IN ('memory', 'workflow', 'rule', 'bugfix') QUALIFY rank <= 18),
v0 AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(greatest(0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS raw FROM cq JOIN embeddings a ON a.vec_id = cq.query_id JOIN ok ON ok.query_id = cq.query_id JOIN embeddings b ON b.vec_id = ok.item_id),
v1 AS (SELECT query_id, 'vector' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM v0 QUALIFY rank <= 18),
di AS (SELECT * FROM m1 UNION ALL SELECT * FROM x5 UNION ALL SELECT * FROM x6 UNION ALL SELECT * FROM v1), sd AS (SELECT DISTINCT query_id, item_id FROM di),
g0 AS (SELECT query_id, dst AS item_id, round(0.68 * {RELATION_SQL} * confidence, 6) AS raw FROM sd JOIN edges ON src = item_id UNION ALL SELECT query_id, src, round(0.68 * {RELATION_SQL} * confidence, 6) FROM sd JOIN edges ON dst = item_id),
g1 AS (SELECT query_id, item_id, max(raw) AS raw FROM g0 SEMI JOIN ok USING (query_id, item_id) GROUP BY 1, 2), g2 AS (SELECT query_id, 'graph' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM g1 QUALIFY rank <= 18),
{_TREE_SQL}, t0 AS (SELECT query_id, {TREE} - regexp_extract(path, '(\\d+)', 1)::INT AS item_id, score FROM tree), t1 AS (SELECT query_id, 'worktree' AS source, item_id, score AS raw, row_number() OVER (PARTITION BY query_id ORDER BY -score, item_id) AS rank FROM t0 SEMI JOIN cq USING (query_id)),
a0 AS (SELECT cq.query_id, wanted_project, lower(p_brand) AS brand, split_part(p_name, ' ', 1) AS word FROM cq JOIN prompts ON prompts.query_id = cq.query_id),
{_TRIGGERED("a", "", 0, _OWN, 0).replace("a0 AS", "af0 AS", 1)}, {_TRIGGERED("us", "", 0, "scope_of = 'user'", 0)}, {_TRIGGERED("ct", "", 0, "scope_of = 'team'", 0)}, {_TRIGGERED("cj", "", 0, f"scope_of = 'project' AND {_OWN}", 1)},
{_PLACED("a1", "atoms", 1, "SELECT * FROM af0")}, {_PLACED("u1", "userStyle", 1, "SELECT * FROM us0")}, {_PLACED("c1", "convention", 1.1, "SELECT * FROM (SELECT * FROM ct0 UNION ALL SELECT * FROM cj0) WHERE -item_id % 7 <> 0")},
h1 AS (SELECT * FROM di UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM u1 UNION ALL SELECT * FROM c1)"""
_MERGED = f"""tw(task, source, delta) AS {_VALUES(_DELTAS)}, tb(task, item_type, bonus) AS {_VALUES([(t, i, v) for t, types, v in P.TYPE_BOOSTS for i in types])}, bo AS (SELECT task, item_type, sum(bonus) AS bonus FROM tb GROUP BY 1, 2),
w0 AS (SELECT h1.*, cq.task, CASE WHEN h1.source = 'convention' THEN 'rule' ELSE it.item_type END AS item_type, len(files) + len(symbols) + len(errors) > 0 AS hard, (list_filter(labels, lambda x: x.type = 'task_type' AND x.value = cq.task))[1].confidence AS own FROM h1 JOIN cq ON cq.query_id = h1.query_id JOIN it ON it.item_id = h1.item_id),
w1 AS (SELECT w0.*, CASE w0.source {" ".join(f"WHEN '{s}' THEN {P.SOURCE_WEIGHTS[s]}::DOUBLE" for s in ORDER)} END + coalesce(tw.delta, 0) + CASE WHEN hard AND w0.source IN ('metadata', 'lexical', 'graph', 'worktree') THEN 0.18 WHEN hard AND w0.source = 'vector' THEN -0.08 ELSE 0 END
 + coalesce(bo.bonus, 0) * CASE WHEN w0.task = 'unknown' OR own IS NULL THEN 1 ELSE least(1.1, greatest(0.5, 0.5 + own * 0.5)) END AS w FROM w0 LEFT JOIN tw ON tw.task = w0.task AND tw.source = w0.source LEFT JOIN bo ON bo.task = w0.task AND bo.item_type = w0.item_type),
mg0 AS (SELECT query_id, item_id, sum(w / (60 + rank)) AS s, max(raw) AS raw, arg_max(source, (raw, CASE source {" ".join(f"WHEN '{s}' THEN {-k}" for k, s in enumerate(ORDER))} END)) AS source, list_sort(list_distinct(list(source))) AS sources FROM w1 GROUP BY 1, 2),
mg1 AS (SELECT mg0.*, round(greatest(0, least(1, least(1, s / greatest(max(s) OVER (PARTITION BY query_id), 0.0001)) * coalesce(round({_FACTOR}, 6), 1))), 6) AS score FROM mg0 LEFT JOIN summary ON summary.item_id = mg0.item_id),
mg AS (SELECT query_id, item_id, score, raw, source, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM mg1)"""
_WHAT = ", ".join(f"list_filter({k}, lambda s: contains(text, lower(s)) OR contains(norm, {_NORM('s')})) AS what_{k}" for k in C.SIGNALS)
_DESC = f"""d0 AS (SELECT mg.*, cq.* EXCLUDE (query_id), it.* EXCLUDE (item_id) REPLACE (CASE WHEN mg.source = 'convention' THEN 'rule' ELSE item_type END AS item_type), lower(concat_ws(' ', title, summary, content, array_to_string(list_sort([x.value FOR x IN labels]), ' '))) AS text FROM mg JOIN cq ON cq.query_id = mg.query_id JOIN it ON it.item_id = mg.item_id),
d1 AS (SELECT *, {_NORM("text")} AS norm FROM d0), ds AS (SELECT *, {_WHAT}, len(list_filter(files || symbols || errors, lambda s: contains(text, lower(s)))) > 0 AS hard FROM d1)"""
_REASONS = "list_sort(list_distinct([x || ' match' FOR x IN sources] || ['file:' || x FOR x IN what_files] || ['symbol:' || x FOR x IN what_symbols] || ['error:' || x FOR x IN what_errors] || CASE item_type WHEN 'memory' THEN ['prior approved memory'] WHEN 'rule' THEN ['standing rule'] ELSE [] END))"
_TOK = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_./:-]+'))"
_RERANK = f"""r0 AS (SELECT *, len(list_intersect({_TOK("prompt")}, {_TOK("concat_ws(' ', title, summary, content)")})) / len({_TOK("prompt")}) AS share FROM ds WHERE rank <= {P.RERANK_LIMIT}),
r1 AS (SELECT *, round(least(1, greatest(0, 0.62::DOUBLE * score + 0.28::DOUBLE * share + 0.1::DOUBLE * least(1, greatest(0, trust / 100)))), 6) AS final FROM r0),
rr AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank, item_id) AS rank FROM r1)"""
_LAB = lambda test: f"len(list_filter(labels, lambda x: {test})) > 0"
_SUPPORTS = f"""CASE e WHEN 'spec' THEN item_type = 'spec' WHEN 'workflow' THEN item_type IN ('workflow', 'rule') WHEN 'code_reference' THEN item_type = 'code_ref' OR {_LAB("x.type IN ('file', 'symbol')")} WHEN 'bugfix' THEN item_type = 'bugfix' OR {_LAB("x.type = 'error' OR (x.type = 'task_type' AND x.value = 'debugging')")}
 WHEN 'reflection_memory' THEN item_type = 'memory' WHEN 'docs' THEN item_type = 'wiki' WHEN 'tests' THEN {_LAB("x.type = 'file' AND regexp_matches(x.value, '(^|/|-)test(s)?[/.]|[.]test[.]')")} ELSE FALSE END"""
_DOMAIN = f"CASE WHEN domain IS NULL THEN NULL WHEN {_LAB('''x.type = 'domain' AND lower(x.value) = lower(domain)''')} THEN TRUE WHEN {_LAB('''x.type = 'domain' AND x.source = 'prompt' ''')} THEN FALSE END"
_PEN = lambda x: f"greatest(0.4, least(1, exp(2.2 * {x})))"
_ADJ = f"""sc AS (SELECT dst AS item_id, max(confidence) AS superseded FROM edges WHERE kind = 'supersedes' GROUP BY 1),
j0 AS (SELECT rr.*, s.latest, sc.superseded, greatest(0, least(1, final * CASE WHEN legacy = 'legacy_replaced' THEN 0.2 ELSE 1 END + coalesce({_ADJUST}, 0)::DOUBLE)) AS f0, coalesce(date_diff('day', fresh_on, DATE '{AS_OF}') > {_STALE}, FALSE) OR coalesce(latest = 'stale', FALSE) AS old, {_DOMAIN} AS dm,
 NOT hard AND len(required) > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(required) AS e) WHERE {_SUPPORTS}) AS mismatch FROM rr LEFT JOIN summary s ON s.item_id = rr.item_id LEFT JOIN sc ON sc.item_id = rr.item_id WHERE legacy IS NULL OR legacy <> 'legacy_archived'),
j1 AS (SELECT *, CASE WHEN superseded IS NULL THEN 1 ELSE {_PEN("-least(0.28, 0.18 + superseded * 0.08)")} END * CASE WHEN old AND NOT hard THEN {_PEN("-0.14")} ELSE 1 END * CASE WHEN hard OR latest IS NULL THEN 1 WHEN latest = 'stale' THEN {_PEN("-0.1")} WHEN latest IN ('rejected', 'irrelevant') THEN {_PEN("-0.08")} ELSE 1 END
 * CASE WHEN dm = FALSE THEN {_PEN("-0.3")} ELSE 1 END * CASE WHEN mismatch THEN {_PEN("-0.1")} ELSE 1 END AS factor FROM j0),
j2 AS (SELECT *, least(1, greatest(0, CASE WHEN f0 > 0.1 THEN greatest(f0 * factor, 0.1) ELSE f0 * factor END + CASE WHEN dm THEN 0.15 ELSE 0 END)) * CASE WHEN source = 'atoms' THEN CASE tier WHEN 'draft' THEN 0.6 WHEN 'canonical' THEN 1.4 ELSE 1 END WHEN source = 'userStyle' THEN CASE tier WHEN 'draft' THEN 0.4 WHEN 'verified' THEN 0.8 WHEN 'canonical' THEN 1.1 ELSE 1 END * CASE WHEN priority = 'personal_workflow' THEN 1.3 ELSE 1 END ELSE 1 END AS f1,
 superseded IS NOT NULL OR (old AND NOT hard) OR coalesce(latest IN ('stale', 'rejected', 'irrelevant') AND NOT hard, FALSE) OR mismatch OR coalesce(NOT dm, FALSE) AS suppressed FROM j1),
aj AS (SELECT * EXCLUDE (final, rank, f0, f1), round(f1::DOUBLE, 6) AS final, row_number() OVER (PARTITION BY query_id ORDER BY round(f1::DOUBLE, 6) DESC, rank, item_id) AS rank FROM j2)"""
_ONTASK = f"(CASE task {' '.join(f'''WHEN '{t}' THEN item_type IN ({', '.join(repr(x) for x in v)})''' for t, v in P.ALIGNED.items())} ELSE FALSE END OR {_LAB('''x.type = 'task_type' AND x.value = task''')})"
_FIT = f"""f0 AS (SELECT *, {_ONTASK} AS on_task, date_diff('day', fresh_on, DATE '{AS_OF}') AS days FROM aj),
f1 AS (SELECT *, least(1, greatest(0, final)) * 0.28::DOUBLE + CASE WHEN wanted_project IS NULL THEN 0 WHEN project = wanted_project THEN 0.1 ELSE -0.18 END::DOUBLE + {" + ".join(f"CASE WHEN len({k}) > 0 THEN len(what_{k}) / len({k}) * {w} ELSE 0 END::DOUBLE" for k, w in P.FIT_COVERAGE.items())}
 + CASE WHEN task = 'unknown' THEN 0 WHEN on_task THEN 0.07 WHEN {_LAB("x.type = 'task_type'")} THEN -0.04 ELSE 0 END::DOUBLE + CASE WHEN trust >= 80 THEN 0.08 WHEN trust >= 50 THEN 0.04 ELSE -0.08 END::DOUBLE
 + CASE WHEN days IS NULL THEN 0 ELSE CASE item_type {" ".join(f"WHEN '{t}' THEN CASE WHEN days <= {a} THEN 0.05 WHEN days > {b} THEN {p} ELSE -0.04 END" for t, (a, b, p) in P.FRESHNESS.items())} ELSE -0.04 END END::DOUBLE
 + CASE safety WHEN 'safe' THEN 0.03 WHEN 'suspicious' THEN -0.08 ELSE 0 END::DOUBLE + CASE WHEN source = 'graph' THEN 0.04 ELSE 0 END::DOUBLE + CASE WHEN latest = 'selected' THEN 0.05 WHEN latest = 'stale' THEN -0.18 WHEN latest IN ('rejected', 'irrelevant') THEN -0.14 ELSE 0 END::DOUBLE
 + CASE WHEN domain IS NULL OR NOT {_LAB("x.type = 'domain'")} THEN 0 WHEN coalesce(dm, TRUE) THEN 0.08 ELSE -0.18 END::DOUBLE AS s FROM f0),
f2 AS (SELECT *, floor(least(1, greatest(0, round(s, 9))) * 1000 + 0.5) / 1000 AS fit FROM f1), f3 AS (SELECT *, round(final * 0.65 + fit * 0.35 + 1e-9, 6) AS comparison FROM f2),
ft AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY comparison DESC, rank, item_id) AS rank FROM f3)"""
_HELD = lambda k: f"len(list_distinct(flatten(list(what_{k}))))"
_COV = list(zip(C.SIGNALS, P.COVERAGE.values(), strict=True))
_AGG = f"""q0 AS (SELECT query_id, {", ".join(f"len(any_value({k})) AS n_{k}, {_HELD(k)} AS h_{k}" for k in C.SIGNALS)}, any_value(task) AS task, any_value(wanted_project) AS wanted_project, any_value(strict) AS strict, max(CASE WHEN rank = 1 THEN fit END) AS top1,
 avg(CASE WHEN rank <= 3 THEN fit END) AS top3, max(coalesce(project = wanted_project, FALSE)) AS in_project, max(on_task) AS on_task, max(CASE WHEN rank <= 3 THEN hard END) AS direct FROM ft WHERE rank <= 6 GROUP BY query_id),
q1 AS (SELECT *, {" + ".join(f"CASE WHEN n_{k} > 0 THEN {w}::DOUBLE * h_{k} / n_{k} ELSE 0 END" for k, w in _COV)} + CASE WHEN in_project THEN 0.08 ELSE 0 END + CASE WHEN task <> 'unknown' AND on_task THEN 0.08 ELSE 0 END AS got,
 {" + ".join(f"CASE WHEN n_{k} > 0 THEN {w}::DOUBLE ELSE 0 END" for k, w in _COV)} + CASE WHEN wanted_project IS NOT NULL THEN 0.08 ELSE 0 END + CASE WHEN task <> 'unknown' THEN 0.08 ELSE 0 END AS whole FROM q0),
q2 AS (SELECT *, round(CASE WHEN whole > 0 THEN got / whole ELSE 0.45 END, 6) AS coverage FROM q1), q3 AS (SELECT *, floor(round((top1 * 0.55 + top3 * 0.2 + coverage * 0.15) / 0.9, 9) * 1000 + 0.5) / 1000 AS raw FROM q2),
q4 AS (SELECT *, CASE WHEN n_files + n_symbols + n_errors = 0 THEN least(raw, 0.71) WHEN h_files + h_symbols + h_errors = 0 THEN least(raw, 0.44) ELSE raw END AS s FROM q3),
q5 AS (SELECT *, CASE WHEN s >= 0.72 THEN 'ready' WHEN s >= 0.45 THEN 'needs_confirmation' ELSE 'insufficient' END AS status, strict AND NOT direct AS lowered FROM q4),
ag AS (SELECT query_id, coverage, round(CASE WHEN lowered AND status = 'needs_confirmation' THEN least(s, 0.44) WHEN lowered AND status = 'ready' THEN least(s, 0.71) ELSE s END, 6)::DOUBLE AS fit_score, CASE WHEN lowered AND status = 'needs_confirmation' THEN 'insufficient' WHEN lowered AND status = 'ready' THEN 'needs_confirmation' ELSE status END AS fit_status FROM q5)"""
_GUIDE = _LAB("(x.type = 'task_type' AND x.value = task) OR (x.type = 'business_area' AND list_contains(areas, x.value))")
_EVID = f"""ac AS (SELECT * FROM ft WHERE rank = 1 OR final >= CASE WHEN len(files) + len(symbols) + len(errors) + len(technologies) + len(areas) > 0 THEN 0.6 ELSE 0.35 END OR (source = 'graph' AND raw >= 0.45 AND superseded IS NULL) OR (source = 'atoms' AND tier IN ('verified', 'canonical') AND NOT suppressed) OR (source = 'convention' AND NOT suppressed)),
e0 AS (SELECT *, least(8, len(what_files) + len(what_symbols) + len(what_errors)) AS n_direct, len(what_files) + len(what_symbols) + len(what_errors) > 0 AS plain FROM ac),
e1 AS (SELECT *, CASE WHEN source = 'atoms' AND tier IN ('verified', 'canonical') THEN 'verifiedAtom' WHEN n_direct > 0 AND coalesce(dm, TRUE) THEN 'directTaskEvidence' WHEN item_type IN ('memory', 'bugfix', 'conversation') AND (fit >= 0.65 OR plain) THEN 'priorLessons'
 WHEN source = 'graph' OR (list_contains(sources, 'vector') AND NOT plain) THEN 'adjacentContext' WHEN item_type IN ('workflow', 'spec', 'rule', 'wiki') OR {_GUIDE} THEN 'workflowGuidance' ELSE 'adjacentContext' END AS category FROM e0),
e2 AS (SELECT *, CASE WHEN category = 'directTaskEvidence' AND (n_direct >= 2 OR fit >= 0.72 OR final >= 0.78) THEN 'strong' WHEN fit >= 0.55 OR final >= 0.65 OR n_direct > 0 THEN 'moderate' ELSE 'weak' END AS strength,
 CASE category WHEN 'verifiedAtom' THEN 0 WHEN 'directTaskEvidence' THEN 1 WHEN 'adjacentContext' THEN 4 ELSE CASE WHEN (category = 'workflowGuidance') = (mode IN {P.GUIDED_MODES}) THEN 2 ELSE 3 END END AS priority_at FROM e1),
ev AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY priority_at, final DESC, rank, item_id) AS rank FROM e2),
cp AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY query_id, category ORDER BY rank) <= CASE category WHEN 'priorLessons' THEN 6 WHEN 'adjacentContext' THEN 4 ELSE 1000000 END)"""
BASE = "WITH " + ",\n".join([K.KB, CTE["atoms"], CTE["edges"], CTE["feedback"], SUMMARY, K.LABELS, K.QUERIES, _ITEMS, _HITS, _MERGED])
STEPS = [BASE, _DESC, _RERANK, _ADJ, _FIT, _AGG, _EVID]
CHAIN = [",\n".join(STEPS[: n + 1]) for n in range(len(STEPS))]


@query(CHAIN[0] + " SELECT * REPLACE (array_to_string(sources, ',') AS sources) FROM mg")
def merged_candidates(spark, d):
    """Metadata, lexical, graph and fact hits of every query, merged by item."""
    return _merged(spark, d)[0].withColumn("sources", F.array_join("sources", ","))


@query(CHAIN[1] + f" SELECT query_id, item_id, array_to_string({_REASONS}, ';') AS reasons, hard FROM ds")
def match_reasons(spark, d):
    return _described(spark, d).select("query_id", "item_id", F.array_join(C.reasons(), ";").alias("reasons"), "hard")


@query(CHAIN[2] + " SELECT query_id, item_id, final, rank FROM rr")
def reranked_candidates(spark, d):
    return C.reranked(_described(spark, d)).select("query_id", "item_id", "final", "rank")


@query(CHAIN[3] + " SELECT query_id, item_id, final, suppressed, rank FROM aj")
def adjusted_candidates(spark, d):
    """Legacy status, feedback, suppression and tiers, then the final order."""
    return _adjusted(spark, d).select("query_id", "item_id", "final", "suppressed", "rank")


@query(CHAIN[4] + " SELECT query_id, item_id, fit, comparison, rank FROM ft")
def candidate_fit(spark, d):
    return _fitted(spark, d).select("query_id", "item_id", "fit", "comparison", "rank")


@query(CHAIN[5] + " SELECT * FROM ag")
def context_fit(spark, d):
    """Aggregate fit of every query, with strict noise tolerance for half of them."""
    return C.aggregate_fit(_fitted(spark, d), F.col("strict"))


@query(CHAIN[6] + " SELECT query_id, item_id, category, strength, n_direct::INT AS n_direct, rank FROM ev")
def evidence_categories(spark, d):
    return C.evidence(C.accepted(_fitted(spark, d))).select("query_id", "item_id", "category", "strength", "n_direct", "rank")


@query(CHAIN[6] + " SELECT query_id, item_id, category, rank FROM cp")
def capped_evidence(spark, d):
    return _capped(spark, d)[0].select("query_id", "item_id", "category", "rank")


@query(CHAIN[6] + """, t AS (SELECT query_id, max(CASE WHEN rank = 1 THEN final END) AS top, count(*) AS n, any_value(classified) AS classified FROM ev GROUP BY 1)
SELECT t.query_id, n, round(least(0.99, greatest(0, top * 0.56::DOUBLE + classified * 0.16::DOUBLE + least(1, n / 6) * 0.08::DOUBLE + coalesce(fit_score, 0) * 0.2::DOUBLE)), 6) AS confidence FROM t LEFT JOIN ag ON ag.query_id = t.query_id""")
def pack_confidence(spark, d):
    _, fits, rows = _capped(spark, d)
    return C.pack_confidence(rows, fits)


_SIZE = "least(700, greatest(1, ceil(length(content) / 4)))::BIGINT"
_GREEDY = lambda rows, n, room: f"list_reduce([{{took: []::BIGINT[], used: 0::BIGINT}}] || [{{took: [x.nr], used: least(x.tokens, {room})}} FOR x IN {rows}], lambda a, x: CASE WHEN len(a.took) < {n} AND a.used + x.used <= {room} THEN {{took: a.took || x.took, used: a.used + x.used}} ELSE a END).took"


@query(CHAIN[6] + f""", z AS (SELECT query_id, item_id, source = 'convention' AS convention, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nr, {_SIZE} AS tokens FROM cp),
z1 AS (SELECT *, convention AND count(*) FILTER (convention) OVER (PARTITION BY query_id ORDER BY nr) <= 5 AS pinned FROM z),
b0 AS (SELECT query_id, list({{nr: nr, item_id: item_id, tokens: tokens}} ORDER BY nr) AS l, coalesce(list({{nr: nr, item_id: item_id, tokens: tokens}} ORDER BY nr) FILTER (NOT pinned), []) AS w, greatest(0, 468 - coalesce(sum(tokens) FILTER (pinned), 0))::BIGINT AS room, coalesce(list(nr) FILTER (pinned), []) AS t0 FROM z1 GROUP BY query_id),
b1 AS (SELECT *, {_GREEDY("w", 4, "room")} AS t1 FROM b0), b2 AS (SELECT *, {_GREEDY("list_filter(w, lambda y: NOT list_contains(t1, y.nr))", 6, 306)} AS t2 FROM b1), b3 AS (SELECT *, {_GREEDY("list_filter(w, lambda y: NOT list_contains(t1 || t2, y.nr))", 8, 126)} AS t3 FROM b2)
SELECT query_id, section, x.item_id AS item_id, x.tokens AS tokens FROM (SELECT query_id, CASE WHEN list_contains(t0 || t1, x.nr) THEN 'essential' WHEN list_contains(t2, x.nr) THEN 'supporting' WHEN list_contains(t3, x.nr) THEN 'optional' END AS section, x FROM (SELECT *, unnest(l) AS x FROM b3)) WHERE section IS NOT NULL""")
def end_to_end_pack(spark, d):
    """The whole way from texts to packs of 900 tokens for every 100th text as a query."""
    rows = _capped(spark, d)[0].select("query_id", "rank", "item_id", F.least(F.lit(700), T.estimate_tokens(F.col("content"))).alias("tokens"), (F.col("source") == "convention").alias("convention"))
    return R.pack(rows, 900)

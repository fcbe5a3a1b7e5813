"""Fusion, feedback, suppression, fit and packing over the searches of the query set."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import policy as P
from ..functions import text as T
from ..operators import ranking as R
from ..operators import search as S
from ..operators import signals
from .bridge import AS_OF, ITEM_TYPES, atoms, edges, feedback, items, pick, prompts, sql_list, with_
from .registry import query
from .search_queries import GRAPH, LEXICAL, VECTOR, atom_items, corpus, lexical_queries, vector_queries, vectors
from .text_queries import _TASK_SQL

BOTH = with_("items") + ",\n" + LEXICAL + ",\n" + VECTOR + ",\nhits AS (SELECT * FROM lexical UNION ALL SELECT * FROM vector)"
FUSED = """f AS (SELECT query_id, item_id, sum(w / (60 + rank)) AS s, count(*) AS n_hits FROM (SELECT *, CASE source WHEN 'lexical' THEN 1.0::DOUBLE ELSE 0.92::DOUBLE END AS w FROM {0}) GROUP BY 1, 2),
n AS (SELECT *, round(least(1, s / greatest(max(s) OVER (PARTITION BY query_id), 0.0001)), 6) AS score FROM f),
fused AS (SELECT query_id, item_id, score, n_hits, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM n)"""


def both(spark, d):
    return S.lexical(lexical_queries(spark, d), corpus(spark, d)).unionByName(S.vector(vector_queries(spark, d), vectors(spark, d)))


def plain(spark, d):
    return R.fuse(both(spark, d), R.source_weight(F.col("source")))


@query(BOTH + ",\n" + FUSED.format("hits") + " SELECT * FROM fused WHERE rank <= 10")
def rrf_fuse(spark, d):
    """Flagship: lexical and vector search, fused by reciprocal ranks."""
    return R.fuse(both(spark, d), R.source_weight(F.col("source")), limit=10)


@query(BOTH + ",\n" + FUSED.format("lexical") + " SELECT * FROM fused WHERE rank <= 10")
def source_ablation(spark, d):
    return R.fuse(both(spark, d), R.source_weight(F.col("source")), limit=10, without=("vector",))


@query(BOTH + " SELECT query_id, item_id, source, round(CASE source WHEN 'lexical' THEN 1.0::DOUBLE ELSE 0.92::DOUBLE END / (60 + rank), 8) AS contribution FROM hits")
def fusion_breakdown(spark, d):
    return R.contributions(both(spark, d), R.source_weight(F.col("source"))).select("query_id", "item_id", "source", F.round("contribution", 8).alias("contribution"))


def task_hits(spark, d):
    """Metadata and graph hits of every 100th prompt, with its task and the items' types."""
    p = signals.classify(prompts(spark, d).where("query_id % 100 = 0"))
    q = p.select("query_id", F.array(F.lower("p_brand")).alias("precise"), F.array(F.element_at(F.split("p_name", " "), 1)).alias("words"))
    a = atoms(spark, d)
    seeds = a.where("atom_id % 100 = 0").select(F.col("atom_id").alias("query_id"), F.col("atom_id").alias("item_id"), "symbols", "tags", "words")
    named = seeds.drop("item_id").join(a.select(F.col("atom_id").alias("item_id"), "symbols", "tags", "words"), ["symbols", "tags", "words"]).where("item_id <> query_id")
    hits = S.metadata(q, atom_items(spark, d)).unionByName(S.graph(seeds, edges(spark, d), named))
    hard = (F.size("files") + F.size("symbols") + F.size("errors") > 0).alias("hard")
    return hits.join(F.broadcast(p.select("query_id", "task", hard)), "query_id").withColumn("item_type", pick(ITEM_TYPES, F.col("item_id") % 8))


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in rows) + ")"


TASK_HITS = (
    with_("prompts", "atoms", "edges") + ",\n" + GRAPH
    + f""",
gh AS (SELECT query_id, 'graph' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM g QUALIFY rank <= 18),
q AS (SELECT query_id, lower(p_brand) AS precise, split_part(p_name, ' ', 1) AS word, {_TASK_SQL} AS task FROM prompts WHERE query_id % 100 = 0),
mr AS (SELECT query_id, atom_id AS item_id, max(CASE WHEN list_contains(symbols, precise) THEN 0.94 ELSE 0.82 END)::DOUBLE AS raw FROM q JOIN atoms ON list_contains(symbols, precise) OR list_contains(words, word) GROUP BY 1, 2),
mh AS (SELECT query_id, 'metadata' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM mr QUALIFY rank <= 18),
hits AS (SELECT h.*, q.task, {sql_list(ITEM_TYPES)}[(item_id % 8) + 1] AS item_type FROM (SELECT * FROM mh UNION ALL SELECT * FROM gh) h JOIN q ON h.query_id = q.query_id),
tw(task, source, delta) AS {_values([(t, s, v) for t, d in P.TASK_WEIGHTS.items() for s, v in d.items()])},
tb(task, item_type, bonus) AS {_values([(t, i, v) for t, types, v in P.TYPE_BOOSTS for i in types])},
bonus AS (SELECT task, item_type, sum(bonus) AS bonus FROM tb GROUP BY 1, 2),
weighed AS (SELECT hits.*, CASE hits.source WHEN 'metadata' THEN {P.SOURCE_WEIGHTS["metadata"]}::DOUBLE ELSE {P.SOURCE_WEIGHTS["graph"]}::DOUBLE END + coalesce(tw.delta, 0) + {P.HARD_SIGNAL_BONUS}::DOUBLE + coalesce(bonus.bonus, 0) AS w
 FROM hits LEFT JOIN tw ON tw.task = hits.task AND tw.source = hits.source LEFT JOIN bonus ON bonus.task = hits.task AND bonus.item_type = hits.item_type),
tf AS (SELECT query_id, item_id, sum(w / (60 + rank)) AS s, count(*) AS n_hits FROM weighed GROUP BY 1, 2),
tn AS (SELECT *, round(least(1, s / greatest(max(s) OVER (PARTITION BY query_id), 0.0001)), 6) AS score FROM tf),
tfused AS (SELECT query_id, item_id, score, n_hits, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM tn)"""
)


def task_fused(spark, d):
    return R.fuse(task_hits(spark, d), R.source_weight(F.col("source"), F.col("task"), F.col("hard"), F.col("item_type")))


@query(TASK_HITS + " SELECT * FROM tfused")
def rrf_task_weights(spark, d):
    return task_fused(spark, d)


SUMMARY = """summary AS (SELECT item_id, count(*) FILTER (feedback_type = 'selected') AS n_selected, count(*) FILTER (feedback_type = 'selected_but_noisy') AS n_noisy, count(*) FILTER (feedback_type = 'rejected') AS n_rejected,
 count(*) FILTER (feedback_type = 'irrelevant') AS n_irrelevant, count(*) FILTER (feedback_type = 'stale') AS n_stale, arg_max(feedback_type, (ts, event_id)) AS latest, max(ts) AS latest_at FROM feedback GROUP BY item_id)"""
_MASS = "(0.18::DOUBLE * n_rejected + 0.22::DOUBLE * n_stale + 0.08::DOUBLE * n_irrelevant + 0.04::DOUBLE * n_noisy - 0.06::DOUBLE * n_selected)"
_FACTOR = f"CASE WHEN {_MASS} <= 0 THEN 1.0 ELSE 0.3 + 0.7 * exp(-{_MASS} * exp(-greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(latest_at)) / 86400000000.0) / 60)) END"
_ADJUST = "least(0.1, n_selected * 0.04) - least(0.08, n_noisy * 0.03) - least(0.24, n_stale * 0.2) - least(0.18, (n_rejected + n_irrelevant) * 0.09)"


@query(with_("feedback") + ",\n" + SUMMARY + " SELECT * FROM summary")
def feedback_summary(spark, d):
    return R.feedback_summary(feedback(spark, d))


@query(with_("feedback") + ",\n" + SUMMARY + f" SELECT item_id, round({_FACTOR}, 6) AS factor FROM summary")
def feedback_factor(spark, d):
    return R.feedback_summary(feedback(spark, d)).select("item_id", F.round(R.feedback_factor(AS_OF), 6).alias("factor"))


@query(BOTH + ",\n" + FUSED.format("hits") + ",\n" + with_("feedback")[5:] + ",\n" + SUMMARY + f""",
j AS (SELECT query_id, fused.item_id, score, round(least(1, greatest(0, score + coalesce({_ADJUST}, 0)::DOUBLE)), 6) AS final FROM fused LEFT JOIN summary ON fused.item_id = summary.item_id)
SELECT query_id, item_id, score, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item_id) AS rank FROM j""")
def feedback_adjust(spark, d):
    from pyspark.sql import Window

    j = plain(spark, d).drop("rank", "n_hits").join(R.feedback_summary(feedback(spark, d)), "item_id", "left")
    final = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") + F.coalesce(R.feedback_adjustment(), F.lit(0.0)))), 6)
    j = j.select("query_id", "item_id", "score", final.alias("final"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("final").desc(), "item_id")))


_SUPERSEDED = "sup AS (SELECT dst AS item_id, src AS by, confidence, row_number() OVER (PARTITION BY dst ORDER BY confidence DESC, src) AS n FROM edges WHERE kind = 'supersedes' QUALIFY n <= 8)"


@query(with_("edges") + ",\n" + _SUPERSEDED.replace("src AS by", "src AS by_id").replace("DESC, src)", "DESC, src)") + " SELECT item_id, by_id, confidence FROM sup")
def superseded_by(spark, d):
    return R.superseded_by(edges(spark, d)).withColumnRenamed("by", "by_id")


_STALE = "CASE item_type " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in P.FRESHNESS.items()) + " ELSE 365 END"


@query(BOTH + ",\n" + FUSED.format("hits") + ",\n" + with_("feedback", "edges")[5:] + ",\n" + SUMMARY + f""",
sc AS (SELECT dst AS item_id, max(confidence) AS confidence FROM edges WHERE kind = 'supersedes' GROUP BY 1),
x AS (SELECT query_id, fused.item_id, score, CASE WHEN sc.confidence IS NULL THEN 1 ELSE greatest(0.4, exp(2.2 * -least(0.28, 0.18 + sc.confidence * 0.08))) END * CASE WHEN date_diff('day', fresh_on, DATE '{AS_OF}') > {_STALE} THEN exp(2.2 * -0.14) ELSE 1 END
 * CASE WHEN latest = 'stale' THEN exp(2.2 * -0.1) WHEN latest IN ('rejected', 'irrelevant') THEN exp(2.2 * -0.08) ELSE 1 END AS factor
 FROM fused LEFT JOIN items ON items.item_id = fused.item_id LEFT JOIN summary ON summary.item_id = fused.item_id LEFT JOIN sc ON sc.item_id = fused.item_id)
SELECT query_id, item_id, round(CASE WHEN score > 0.1 THEN greatest(score * factor, 0.1) ELSE score * factor END, 6) AS final FROM x""")
def suppression(spark, d):
    strongest = edges(spark, d).where("kind = 'supersedes'").groupBy(F.col("dst").alias("item_id")).agg(F.max("confidence").alias("superseded"))
    j = plain(spark, d).join(items(spark, d).select("item_id", "item_type", "fresh_on"), "item_id", "left").join(R.feedback_summary(feedback(spark, d)).select("item_id", "latest"), "item_id", "left").join(strongest, "item_id", "left")
    stale = F.coalesce(F.date_diff(F.lit(AS_OF).cast("date"), "fresh_on") > R.stale_after(F.col("item_type")), F.lit(False))
    final = R.suppress(F.col("score"), F.col("superseded"), stale, F.col("latest"), F.lit(False), F.lit(None).cast("boolean"))
    return j.select("query_id", "item_id", F.round(final, 6).alias("final"))


COVER = f"""sig AS (SELECT query_id, 'symbol' AS kind, precise AS value, {P.COVERAGE["symbol"]}::DOUBLE AS weight FROM q UNION ALL SELECT query_id, 'file', word, {P.COVERAGE["file"]}::DOUBLE FROM q),
held AS (SELECT DISTINCT query_id, unnest(list_concat(symbols, words)) AS value FROM tfused JOIN atoms ON atom_id = item_id WHERE rank <= 6),
hit AS (SELECT sig.*, held.value IS NOT NULL AS h FROM sig LEFT JOIN held ON held.query_id = sig.query_id AND held.value = sig.value),
cover AS (SELECT query_id, count(*) AS n_signals, sum(h::INT)::BIGINT AS n_covered, sum(weight * h::INT) / sum(weight) AS coverage FROM hit GROUP BY 1)"""


def _coverage(spark, d, fused):
    p = prompts(spark, d).where("query_id % 100 = 0")
    symbol = p.select("query_id", F.lit("symbol").alias("kind"), F.lower("p_brand").alias("value"), F.lit(P.COVERAGE["symbol"]).alias("weight"))
    file = p.select("query_id", F.lit("file").alias("kind"), F.element_at(F.split("p_name", " "), 1).alias("value"), F.lit(P.COVERAGE["file"]).alias("weight"))
    held = fused.join(atoms(spark, d).select(F.col("atom_id").alias("item_id"), F.concat("symbols", "words").alias("values")), "item_id")
    return R.signal_coverage(symbol.unionByName(file), held)


@query(TASK_HITS + ",\n" + COVER + " SELECT query_id, n_signals, n_covered, round(coverage, 6) AS coverage FROM cover")
def coverage(spark, d):
    return _coverage(spark, d, task_fused(spark, d)).withColumn("coverage", F.round("coverage", 6))


FIT = """top AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top1, avg(score) AS top3 FROM tfused WHERE rank <= 3 GROUP BY 1),
fit AS (SELECT top.query_id, top1, top3, coalesce(coverage, 0) AS coverage, floor((top1 * 0.55 + top3 * 0.2 + coalesce(coverage, 0) * 0.15) / 0.9 * 1000 + 0.5) / 1000 AS fit_score FROM top LEFT JOIN cover ON cover.query_id = top.query_id)"""


@query(TASK_HITS + ",\n" + COVER + ",\n" + FIT + f" SELECT query_id, round(top1, 6) AS top1, round(top3, 6) AS top3, round(coverage, 6) AS coverage, fit_score, CASE WHEN fit_score >= {P.READY} THEN 'ready' WHEN fit_score >= {P.CONFIRM} THEN 'needs_confirmation' ELSE 'insufficient' END AS fit_status FROM fit")
def fit_status(spark, d):
    fused = task_fused(spark, d)
    return R.fit(fused, _coverage(spark, d, fused).select("query_id", "coverage"))


@query(TASK_HITS + ",\n" + COVER + ",\n" + FIT + f" SELECT query_id, CASE WHEN fit_score >= {P.READY} THEN 'proceed' WHEN fit_score >= {P.CONFIRM} THEN 'confirm' ELSE 'clarify' END AS verdict FROM fit")
def startup_verdict(spark, d):
    s = F.col("fit_status")
    return fit_status(spark, d).select("query_id", F.when(s == "ready", "proceed").when(s == "needs_confirmation", "confirm").otherwise("clarify").alias("verdict"))


def _sized(spark, d):
    c = corpus(spark, d).select("item_id", F.least(F.lit(700), T.estimate_tokens(F.col("content"))).alias("tokens"))
    return plain(spark, d).join(c, "item_id").select("query_id", "rank", "item_id", "tokens")


@query(BOTH + ",\n" + FUSED.format("hits") + """,
z AS (SELECT query_id, rank, fused.item_id, least(700, greatest(1, ceil(length(content) / 4)))::BIGINT AS tokens FROM fused JOIN items ON items.item_id = fused.item_id WHERE status = 'approved')
SELECT query_id, rank, item_id, tokens, (sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM z QUALIFY used <= 4000""")
def deep_context(spark, d):
    return R.within_budget(_sized(spark, d), 4000)


@query()
def pack_sections(spark, d):
    """Greedy sections of a 4,000-token pack; order-dependent, so held against plain Python in the tests."""
    return R.pack(_sized(spark, d), 4000)


@query(with_("prompts") + """,
r AS (SELECT query_id AS rule_id, p_name AS scope, p_size % 2 = 1 AS negated, list_distinct(string_split(lower(p_type || ' ' || p_brand), ' ')) AS words FROM prompts),
w AS (SELECT rule_id, scope, negated, len(words) AS n, unnest(words) AS w FROM r)
SELECT least(a.rule_id, b.rule_id) AS left_id, greatest(a.rule_id, b.rule_id) AS right_id, count(*) AS shared FROM w a JOIN w b ON a.scope = b.scope AND a.w = b.w AND a.negated AND NOT b.negated GROUP BY a.rule_id, b.rule_id, least(a.n, b.n) HAVING count(*) * 2 >= least(a.n, b.n)""")
def style_conflicts(spark, d):
    p = prompts(spark, d)
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand")), " "))
    return R.style_conflicts(p.select(F.col("query_id").alias("rule_id"), F.col("p_name").alias("scope"), words.alias("words"), (F.col("p_size") % 2 == 1).alias("negated")))

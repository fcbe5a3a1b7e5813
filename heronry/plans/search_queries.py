"""Search over the corpus. The query set is every row whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import policy as P
from ..functions import text as T
from ..operators import ranked_text
from ..operators import search as S
from ..operators import vector_index
from .bridge import atoms, edges, items, prompts, read, with_
from .registry import query


def lexical_queries(spark, d):
    """Terms of every 100th document: its technologies, business areas and compounds, then its other words, the first 32."""
    docs = read(spark, d, "documents").where("doc_id % 100 = 0")
    c = F.col("text")
    exact = F.concat(T.terms_in(c, P.TECHNOLOGIES), T.hints_in(c, P.BUSINESS_AREAS), T.compounds(c))
    return docs.select(F.col("doc_id").alias("query_id"), T.lexical_terms(c, exact).alias("terms"))


def corpus(spark, d):
    return items(spark, d).where("status = 'approved'").select("item_id", "item_type", "content")


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, d):
    return vectors(spark, d).where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vector")


def atom_items(spark, d):
    return atoms(spark, d).select(F.col("atom_id").alias("item_id"), F.col("symbols").alias("labels"), "words")


RELATION_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.RELATION_MULTIPLIERS.items()) + " ELSE 1.0 END::DOUBLE"


def terms_sql(text: str) -> str:
    """SQL of the terms that lexical_queries takes of a text, distinct ones not yet taken out."""
    tech = ", ".join("CASE WHEN regexp_matches(lower({}), '{}') THEN '{}' END".format(text, P.TERM_PATTERNS.get(t, rf"\b{t}\b"), t) for t in P.TECHNOLOGIES)
    areas = ", ".join(f"CASE WHEN contains(lower({text}), '{t}') THEN '{t}' END" for t in P.BUSINESS_AREAS)
    words = f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9_./:-]{{3,}}'), lambda x: x NOT IN ({', '.join(repr(w) for w in P.STOP_WORDS)}))"
    return f"list_filter([{tech}, {areas}], lambda x: x IS NOT NULL) || list_filter(regexp_extract_all(lower({text}), '{P.COMPOUND_PATTERN}'), lambda x: length(x) >= 5) || {words}"


LEXICAL = f"""lraw AS (SELECT doc_id AS query_id, {terms_sql("text")} AS l FROM documents WHERE doc_id % 100 = 0),
lq AS (SELECT query_id, (list_filter(l, lambda x, i: list_position(l, x) = i))[1:32] AS terms FROM lraw),
lt AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM lq),
low AS (SELECT item_id, item_type, lower(content) AS low FROM items WHERE status = 'approved'),
ls AS (SELECT query_id, item_id, item_type, round(count(*) / n_terms, 6) AS raw FROM lt JOIN low ON contains(low, term) GROUP BY query_id, item_id, item_type, n_terms),
lexical AS (SELECT query_id, 'lexical' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM ls QUALIFY rank <= 18)"""
VECTOR = """vs AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, c.label, round(greatest(0, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6) AS raw FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
vector AS (SELECT query_id, 'vector' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM vs QUALIFY rank <= 18)"""


@query(with_("items") + ",\n" + LEXICAL + " SELECT * FROM lexical")
def lexical_topk(spark, d):
    return S.lexical(lexical_queries(spark, d), corpus(spark, d))


@query("WITH " + VECTOR + " SELECT * FROM vector")
def vector_topk(spark, d):
    return S.vector(vector_queries(spark, d), vectors(spark, d))


_STEM = "CASE WHEN regexp_matches(w, 'ies$') AND NOT regexp_matches(w, '[ea]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, 'es$') AND NOT regexp_matches(w, '[aeo]es$') THEN regexp_replace(w, 's$', '') WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '[us]s$') THEN regexp_replace(w, 's$', '') ELSE w END"
_WORDS = lambda text: f"list_transform(regexp_extract_all(lower(coalesce({text}, '')), '{ranked_text.WORD}'), lambda w: {_STEM})"


@query(with_("items") + f""",
tq AS (SELECT doc_id AS query_id, list_filter({_WORDS("text")}, lambda w: w NOT IN ({", ".join(f"'{w}'" for w in ranked_text.STOP)}) AND length(w) >= 4) AS l FROM documents WHERE doc_id % 100 = 0),
tr AS (SELECT query_id, (list_filter(l, lambda x, i: list_position(l, x) = i))[1:3] AS terms FROM tq), te AS (SELECT query_id, len(terms) AS n, unnest(terms) AS w, unnest(range(1, len(terms) + 1)) AS term FROM tr),
do1 AS (SELECT item_id, {_WORDS("concat_ws(' ', item_type, project, content)")} AS a, {_WORDS("content")} AS b FROM items WHERE status = 'approved'),
pl AS (SELECT item_id, unnest(a || b) AS w, unnest(range(0, len(a) + len(b))) AS pos, len(a) AS na FROM do1),
en AS (SELECT query_id, item_id, n, term, pos, CASE WHEN pos < na THEN 1.0 ELSE 2.5 END::DOUBLE AS inv, row_number() OVER (PARTITION BY query_id, item_id ORDER BY pos) AS nr FROM pl JOIN te USING (w)),
cu AS (SELECT *, sum(inv) OVER o AS upto, max(CASE WHEN term = 1 THEN nr END) OVER o AS l1, CASE WHEN n >= 2 THEN max(CASE WHEN term = 2 THEN nr END) OVER o ELSE 1000000000 END AS l2, CASE WHEN n >= 3 THEN max(CASE WHEN term = 3 THEN nr END) OVER o ELSE 1000000000 END AS l3
 FROM en WINDOW o AS (PARTITION BY query_id, item_id ORDER BY nr)),
co AS (SELECT *, least(l1, l2, l3) AS p FROM cu WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL),
cv AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY query_id, item_id, p ORDER BY nr) = 1),
ds AS (SELECT c.query_id, c.item_id, round(sum((c.nr - c.p + 1) / (c.upto - e.upto + e.inv) / (1 + c.pos - e.pos - (c.nr - c.p))), 6) AS raw FROM cv c JOIN cu e ON e.query_id = c.query_id AND e.item_id = c.item_id AND e.nr = c.p GROUP BY 1, 2)
SELECT query_id, 'lexical' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM ds QUALIFY rank <= 18""")
def ranked_full_text(spark, d):
    """Texts that hold the first three words (of four characters or more) of every 100th document, by cover density."""
    q = read(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.slice(F.array_distinct(F.filter(ranked_text.words(F.col("text")), lambda w: ~w.isin(*ranked_text.STOP) & (F.length(w) >= 4))), 1, 3).alias("terms"))
    i = items(spark, d).where("status = 'approved'").select("item_id", F.concat_ws(" ", "item_type", "project", "content").alias("described"), "content")
    return ranked_text.search(q, i)


@query()
def vector_index_topk(spark, d):
    """As vector_topk, by the index of cells; tests hold its recall against all cosines."""
    return vector_index.search(vector_queries(spark, d), vectors(spark, d))


@query()
def atom_vector_index(spark, d):
    """The nearest facts of every probe, of those that are in use, by the index of cells."""
    in_use = atoms(spark, d).where("status = 'active'").select(F.col("atom_id").alias("item_id"))
    return vector_index.search(vector_queries(spark, d), vectors(spark, d).join(in_use, "item_id", "left_semi"))


@query(with_("items") + ",\n" + LEXICAL + """, m AS (SELECT query_id, item_id, raw + 0.15 AS raw FROM ls WHERE item_type IN ('memory', 'workflow', 'rule', 'bugfix'))
SELECT query_id, 'memory' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM m QUALIFY rank <= 18""")
def memory_search(spark, d):
    return S.memory(lexical_queries(spark, d), corpus(spark, d))


@query("WITH " + VECTOR + """, b AS (SELECT query_id, label AS item_id, max(raw) AS raw FROM vs GROUP BY 1, 2)
SELECT query_id, 'vector' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM b QUALIFY rank <= 18""")
def item_best_chunk(spark, d):
    chunks = vectors(spark, d).select(F.col("item_id").alias("chunk_id"), F.col("label").alias("item_id"), "vector")
    return S.best_chunk(vector_queries(spark, d), chunks)


@query("WITH " + VECTOR + " SELECT query_id, item_id, raw FROM vs WHERE raw >= 0.3 AND query_id <> item_id")
def atom_vector(spark, d):
    """All facts at least so similar to a probe."""
    return S.in_blocks(vector_queries(spark, d), lambda q: S.vector_scores(q, vectors(spark, d)).where("raw >= 0.3 AND query_id <> item_id"))


@query(with_("prompts", "atoms") + """,
q AS (SELECT query_id, lower(p_brand) AS precise, split_part(p_name, ' ', 1) AS word FROM prompts WHERE query_id % 100 = 0),
h AS (SELECT query_id, atom_id AS item_id, max(CASE WHEN list_contains(symbols, precise) THEN 0.94 ELSE 0.82 END)::DOUBLE AS raw FROM q JOIN atoms ON list_contains(symbols, precise) OR list_contains(words, word) GROUP BY 1, 2)
SELECT query_id, 'metadata' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM h QUALIFY rank <= 18""")
def metadata_match(spark, d):
    q = prompts(spark, d).where("query_id % 100 = 0").select("query_id", F.array(F.lower("p_brand")).alias("precise"), F.array(F.element_at(F.split("p_name", " "), 1)).alias("words"))
    return S.metadata(q, atom_items(spark, d))


GRAPH = f"""named AS (SELECT q.atom_id AS query_id, a.atom_id AS item_id, {P.HOP_WEIGHTS["target"]}::DOUBLE AS raw FROM atoms q JOIN atoms a ON q.symbols = a.symbols AND q.tags = a.tags AND q.words = a.words WHERE q.atom_id % 100 = 0 AND a.atom_id <> q.atom_id),
walked AS (SELECT src AS query_id, dst AS item_id, round({P.HOP_WEIGHTS["seed"]} * {RELATION_SQL} * confidence, 6) AS raw FROM edges WHERE src % 100 = 0 UNION ALL
 SELECT dst, src, round({P.HOP_WEIGHTS["seed"]} * {RELATION_SQL} * confidence, 6) FROM edges WHERE dst % 100 = 0),
g AS (SELECT query_id, item_id, max(raw) AS raw FROM (SELECT * FROM named UNION ALL SELECT * FROM walked) GROUP BY 1, 2)"""


@query(with_("atoms", "edges") + ",\n" + GRAPH + " SELECT query_id, 'graph' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM g QUALIFY rank <= 18")
def graph_search(spark, d):
    a = atoms(spark, d)
    seeds = a.where("atom_id % 100 = 0").select(F.col("atom_id").alias("query_id"), F.col("atom_id").alias("item_id"), "symbols", "tags", "words")
    named = seeds.drop("item_id").join(a.select(F.col("atom_id").alias("item_id"), "symbols", "tags", "words"), ["symbols", "tags", "words"]).where("item_id <> query_id")
    return S.graph(seeds, edges(spark, d), named)


@query(with_("edges") + f""",
s AS (SELECT DISTINCT src AS query_id, dst AS mid FROM edges WHERE src % 100 = 0),
known AS (SELECT query_id, mid AS item FROM s UNION SELECT query_id, query_id FROM s),
x AS (SELECT DISTINCT s.query_id, e.src, e.dst, e.kind, e.confidence FROM s JOIN edges e ON e.src = s.mid WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.query_id = s.query_id AND k.item = e.dst)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, src, dst, kind) AS n FROM x QUALIFY n <= 16),
g AS (SELECT query_id, dst AS item_id, max(round({P.HOP_WEIGHTS["depth2"]} * {RELATION_SQL} * confidence, 6)) AS raw FROM f GROUP BY 1, 2)
SELECT query_id, 'graph' AS source, item_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS rank FROM g QUALIFY rank <= 18""")
def graph_depth2(spark, d):
    seeds = atoms(spark, d).where("atom_id % 100 = 0").select(F.col("atom_id").alias("query_id"), F.col("atom_id").alias("item_id"))
    return S.graph_depth2(seeds, edges(spark, d))


@query(with_("prompts", "atoms") + """,
q AS (SELECT query_id, lower(p_brand) AS brand, split_part(p_name, ' ', 1) AS word FROM prompts WHERE query_id % 100 = 0)
SELECT query_id, atom_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY CASE tier WHEN 'canonical' THEN 3 WHEN 'verified' THEN 2 ELSE 1 END DESC, last_reused DESC NULLS LAST, atom_id) AS rank
FROM q JOIN atoms ON list_contains(symbols, brand) OR list_contains(words, word) WHERE status = 'active' QUALIFY rank <= 18""")
def atom_trigger(spark, d):
    q = prompts(spark, d).where("query_id % 100 = 0").select("query_id", F.array(F.lower("p_brand"), F.element_at(F.split("p_name", " "), 1)).alias("keys"))
    return S.by_trigger(q, atoms(spark, d).withColumn("keys", F.concat("symbols", "words")))


@query(with_("atoms") + " SELECT atom_id, tier, 'team' AS scope FROM atoms WHERE status = 'active' AND atom_id % 4 = 1 UNION ALL SELECT atom_id, tier, 'project' FROM atoms WHERE status = 'active' AND atom_id % 4 = 2 AND tier <> 'draft'")
def convention_lane(spark, d):
    a = atoms(spark, d).where("status = 'active'")
    team = a.where("atom_id % 4 = 1").select("atom_id", "tier", F.lit("team").alias("scope"))
    return team.unionByName(a.where("atom_id % 4 = 2 AND tier <> 'draft'").select("atom_id", "tier", F.lit("project").alias("scope")))


@query(with_("items") + ",\n" + LEXICAL + ",\n" + VECTOR + f""", b AS (SELECT query_id, max(raw) AS best FROM (SELECT * FROM lexical UNION ALL SELECT * FROM vector) WHERE rank <= 5 GROUP BY 1)
SELECT lq.query_id, coalesce(best, 0) AS best, coalesce(best, 0) < {P.PROBE} AS rewrite FROM lq LEFT JOIN b ON lq.query_id = b.query_id""")
def probe_gate(spark, d):
    q = lexical_queries(spark, d)
    return S.probe(S.lexical(q, corpus(spark, d)).unionByName(S.vector(vector_queries(spark, d), vectors(spark, d))), q)

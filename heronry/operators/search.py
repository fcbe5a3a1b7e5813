"""Candidate search for batches of queries. All results are rows of query_id, source, item_id, raw, rank.

Queries are sent in blocks of a stated size (BLOCK), each with its own top-k; the corpus is never joined with itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..functions import vectors as V
from ..sources.shared import cut
from . import cosines, postings

#: Characters of the gram by which a key meets the keys that may hold it.
GRAM = 3
#: Queries, about, that meet the corpus at a time; larger sets are cut into blocks by a hash of query_id.
BLOCK = 10_000


def in_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The union of search(block) of all blocks of queries. Results of several blocks are written one after another, so one block's hits exist at a time."""
    n = -(-queries.count() // BLOCK)
    if n <= 1:
        return search(queries)
    own = cut(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n))))
    return reduce(DataFrame.unionByName, [cut(search(own.where(F.col("_block") == k).drop("_block"))) for k in range(n)])


def ranked(hits: DataFrame, source: str, limit: int = P.SEARCH_LIMIT, *ties: Column) -> DataFrame:
    """The best `limit` hits (query_id, item_id, raw) of each query; ties by item_id last."""
    order = Window.partitionBy("query_id").orderBy(F.col("raw").desc(), *ties, "item_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.select("query_id", F.lit(source).alias("source"), "item_id", "raw", "rank")


def lexical_scores(queries: DataFrame, known: postings.Index, limit: int) -> DataFrame:
    """query_id, item_id, raw: the share of a query's distinct terms that stand anywhere in a text, for one block of queries; the best of each part of the index, `limit` at most."""
    return postings.search(known, queries, limit).select("query_id", "item_id", F.round(F.col("n") / F.col("n_terms"), 6).alias("raw"))


def lexical(queries: DataFrame, corpus: DataFrame, limit: int = P.SEARCH_LIMIT, group: str | None = None) -> DataFrame:
    """queries: query_id, terms; with group, a column of corpus, also wanted; and rejected, ids that a query leaves out."""
    known = postings.build(corpus, group)
    return in_blocks(queries, lambda q: ranked(lexical_scores(q, known, limit), "lexical", limit))


def memory(queries: DataFrame, corpus: DataFrame, limit: int = P.SEARCH_LIMIT, group: str | None = None) -> DataFrame:
    """Lexical search over remembered kinds of items, 0.15 higher."""
    known = postings.build(corpus.where(F.col("item_type").isin("memory", "workflow", "rule", "bugfix")), group)
    return in_blocks(queries, lambda q: ranked(lexical_scores(q, known, limit).withColumn("raw", F.col("raw") + 0.15), "memory", limit))


def vector_scores(queries: DataFrame, corpus: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, item_id, raw: cosine, 0 at least, of one block of queries (query_id, vector) and corpus (item_id, vector).

    With limit, only what can be among the best `limit` of a query goes on; then queries may also have wanted (a group, g of corpus) and rejected (ids).
    """
    if limit is not None:
        return cosines.best(queries, corpus, limit).withColumn("raw", F.round("raw", 6))
    q = queries.select("query_id", F.col("vector").alias("_q"), V.norm(F.col("vector")).alias("_nq"))
    c = corpus.select("item_id", F.col("vector").alias("_c"), V.norm(F.col("vector")).alias("_nc"))
    n = F.col("_nq") * F.col("_nc")
    cosine = F.when(n > 0, V.dot(F.col("_q"), F.col("_c")) / n).otherwise(0.0)
    return c.crossJoin(F.broadcast(q)).select("query_id", "item_id", F.round(F.greatest(F.lit(0.0), cosine), 6).alias("raw"))


def vector(queries: DataFrame, corpus: DataFrame, limit: int = P.SEARCH_LIMIT) -> DataFrame:
    """queries: query_id, vector; and, as they may be, wanted (a group, then g of corpus) and rejected, ids that a query leaves out."""
    return in_blocks(queries, lambda q: ranked(vector_scores(q, corpus, limit), "vector", limit))


def best_chunk(queries: DataFrame, chunks: DataFrame, limit: int = P.SEARCH_LIMIT) -> DataFrame:
    """Items by their best chunk: chunks has chunk_id, item_id, vector."""
    own = chunks.select(F.struct("chunk_id", F.col("item_id").alias("of")).alias("item_id"), "vector")
    best = lambda q: vector_scores(q, own).groupBy("query_id", F.col("item_id.of").alias("item_id")).agg(F.max("raw").alias("raw"))
    return in_blocks(queries, lambda q: ranked(best(q), "vector", limit))


def _first_of_key(items: DataFrame, keys: str, limit: int, *order: Column | str) -> DataFrame:
    """k and the rows of items that come first under each of their keys, and in each of their scopes if they have one. All hits of a key score alike, so no query can rank more of them."""
    each = items.select("*", F.explode(F.array_distinct(keys)).alias("k"))
    by = ["k", "scope"] if "scope" in items.columns else ["k"]
    return each.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def most_rejected(rejected: DataFrame | None) -> int:
    """The most rows that one query rejects: by so many more are kept where rows are cut before queries meet them."""
    return 0 if rejected is None else rejected.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0


def in_scopes(rows: DataFrame, project: str = "project") -> DataFrame:
    """Each row twice: in the scope of all projects, and in that of its own."""
    return rows.withColumn("scope", F.explode(F.array(F.lit("*"), F.concat(F.lit("="), F.col(project)))))


def scope_of(wanted: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), wanted), F.lit("*"))


def by_label(signals: DataFrame, labels: DataFrame, limit: int = P.SEARCH_LIMIT, rejected: DataFrame | None = None) -> DataFrame:
    """0.94 where an item has a precise signal of the query as a label, 0.82 where it has another; then by trust and freshness.

    signals: query_id, type, value, precise and, if queries are for a project, wanted; labels: item_id, type, value, trust,
    fresh_on and, then, project. Under each label only as many items as a query can rank are kept, and as many more as a query
    rejects (rejected: query_id, item_id), before they meet signals.
    """
    order = (F.col("trust").desc(), F.col("fresh_on").desc_nulls_last(), "item_id")
    limited = "wanted" in signals.columns
    labels = in_scopes(labels) if limited else labels.withColumn("scope", F.lit("*"))
    signals = signals.withColumn("scope", scope_of(F.col("wanted")) if limited else F.lit("*"))
    first = labels.withColumn("_n", F.row_number().over(Window.partitionBy("type", "value", "scope").orderBy(*order))).where(F.col("_n") <= limit + most_rejected(rejected)).drop("_n")
    hits = signals.join(first, ["type", "value", "scope"]).groupBy("query_id", "item_id", "trust", "fresh_on").agg(F.max(F.when(F.col("precise"), 0.94).otherwise(0.82)).alias("raw"))
    if rejected is not None:
        hits = hits.join(rejected.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    return ranked(hits, "metadata", limit, *order[:2])


def metadata(queries: DataFrame, items: DataFrame, limit: int = P.SEARCH_LIMIT) -> DataFrame:
    """0.94 where a label equals a precise term of the query, 0.82 where a word does: queries (query_id, precise, words), items (item_id, labels, words)."""
    exact = queries.select("query_id", F.explode("precise").alias("k")).join(_first_of_key(items, "labels", limit, "item_id"), "k").select("query_id", "item_id", F.lit(0.94).alias("raw"))
    loose = queries.select("query_id", F.explode("words").alias("k")).join(_first_of_key(items, "words", limit, "item_id"), "k").select("query_id", "item_id", F.lit(0.82).alias("raw"))
    return ranked(exact.unionByName(loose).groupBy("query_id", "item_id").agg(F.max("raw").alias("raw")), "metadata", limit)


def _relation(kind: str = "kind") -> Column:
    return F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in P.RELATION_MULTIPLIERS.items()], F.lit(1.0))


def graph(seeds: DataFrame, edges: DataFrame, targets: DataFrame, limit: int = P.SEARCH_LIMIT, allowed: Callable[[DataFrame], DataFrame] = lambda hits: hits) -> DataFrame:
    """Best of three branches for each item: named targets (query_id, item_id), edges out of seeds (query_id, item_id) and edges into them. allowed filters hits before the best are chosen."""
    s = seeds.select("query_id", F.col("item_id").alias("seed"))
    weigh = lambda w: F.round(F.lit(w) * _relation() * F.col("confidence"), 6).alias("raw")
    out = edges.join(s, F.col("src") == F.col("seed")).select("query_id", F.col("dst").alias("item_id"), weigh(P.HOP_WEIGHTS["seed"]))
    back = edges.join(s, F.col("dst") == F.col("seed")).select("query_id", F.col("src").alias("item_id"), weigh(P.HOP_WEIGHTS["seed"]))
    named = targets.select("query_id", "item_id", F.lit(P.HOP_WEIGHTS["target"]).alias("raw"))
    return ranked(allowed(named.unionByName(out).unionByName(back).groupBy("query_id", "item_id").agg(F.max("raw").alias("raw"))), "graph", limit)


def graph_depth2(seeds: DataFrame, edges: DataFrame, limit: int = P.SEARCH_LIMIT, first: int = 16) -> DataFrame:
    """Items two steps out: the first edges (by confidence) that leave the first step's items for new ones."""
    s = seeds.select("query_id", F.col("item_id").alias("seed"))
    step = edges.join(s, F.col("src") == F.col("seed")).select("query_id", "seed", F.col("dst").alias("mid")).distinct()
    known = step.select("query_id", F.col("mid").alias("dst")).union(s.select("query_id", "seed")).distinct()
    cross = edges.join(step, F.col("src") == F.col("mid")).select("query_id", "src", "dst", "kind", "confidence").distinct().join(known, ["query_id", "dst"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "src", "dst", "kind")
    kept = cross.withColumn("n", F.row_number().over(order)).where(F.col("n") <= first)
    scored = kept.groupBy("query_id", F.col("dst").alias("item_id")).agg(F.max(F.round(P.HOP_WEIGHTS["depth2"] * _relation() * F.col("confidence"), 6)).alias("raw"))
    return ranked(scored, "graph", limit)


def by_trigger(queries: DataFrame, atoms: DataFrame, limit: int = P.SEARCH_LIMIT) -> DataFrame:
    """Active facts that share a trigger key with a query: queries (query_id, keys), atoms (atom_id, keys, tier, last_reused). With queries that have wanted, facts (then with project) are those of that project."""
    tier = F.when(F.col("tier") == "canonical", 3).when(F.col("tier") == "verified", 2).otherwise(1)
    limited = "wanted" in queries.columns
    own = atoms.where("status = 'active'").select("atom_id", "tier", "last_reused", "keys", *(["project"] if limited else []))
    k = _first_of_key(in_scopes(own).drop("project") if limited else own, "keys", limit, tier.desc(), F.col("last_reused").desc_nulls_last(), "atom_id").drop("keys")
    asked = queries.select("query_id", F.explode("keys").alias("k"), *([scope_of(F.col("wanted")).alias("scope")] if limited else []))
    hits = asked.join(k, ["k", "scope"] if limited else ["k"]).select("query_id", "atom_id", "tier", "last_reused").distinct()
    order = Window.partitionBy("query_id").orderBy(tier.desc(), F.col("last_reused").desc_nulls_last(), "atom_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "atom_id", "tier", "rank")


def _holding(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word, term: which different words (column k) hold which different terms (column k). They meet by one gram of the term; terms shorter than a gram by all runs of one or two characters."""
    size = F.least(F.length("k"), F.lit(GRAM))
    runs = lambda n: F.array_distinct(F.regexp_extract_all("k", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    grams = words.select(F.col("k").alias("word"), F.explode(F.concat(*[runs(n) for n in range(1, GRAM + 1)])).alias("gram"))
    own = terms.where("k <> ''").select(F.col("k").alias("term"), F.substr("k", F.lit(1), size).alias("gram"))
    return grams.join(own, "gram").where(F.contains("word", F.col("term"))).select("word", "term").distinct()


def by_substring(queries: DataFrame, atoms: DataFrame, limit: int = P.SEARCH_LIMIT) -> DataFrame:
    """query_id, atom_id: facts (atom_id, keys) with a key that holds one of a query's keys or lies in it, whatever the case; the first `limit` by id.

    Only different keys are held against each other; under each key of a query as many facts are kept as it can be given.
    """
    q = queries.select("query_id", F.explode("keys").alias("k")).select("query_id", F.lower("k").alias("k")).distinct()
    a = atoms.select("atom_id", F.explode("keys").alias("k")).select("atom_id", F.lower("k").alias("k")).distinct()
    mine, theirs = q.select("k").distinct(), a.select("k").distinct()
    met = _holding(theirs, mine).select(F.col("term").alias("k"), F.col("word").alias("key")).union(_holding(mine, theirs).select("word", "term")).distinct()
    facts = met.join(a.select(F.col("k").alias("key"), "atom_id"), "key").select("k", "atom_id").distinct()
    first = facts.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("atom_id"))).where(F.col("n") <= limit)
    hits = q.join(first, "k").select("query_id", "atom_id").distinct()
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("atom_id"))).where(F.col("n") <= limit).drop("n")


def probe(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, best, rewrite: whether no hit is good enough to leave a query as it is."""
    best = hits.where("rank <= 5").groupBy("query_id").agg(F.max("raw").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("best", F.lit(0.0)) < P.PROBE).alias("rewrite"))

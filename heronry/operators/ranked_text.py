"""Full-text ranking by cover density: all terms must stand in a text, and near each other counts more.

Words are runs of letters and digits in lower case, with a plural ending taken off; stop words keep their place but are no
terms. A text is an A part (what describes it) followed by a B part (itself), with weights 1 and 0.4. A cover is a shortest
stretch that holds all terms of a query; it gives the harmonic mean of its words' weights, divided by one more than the
number of other words in it, and a text's score is the sum over its covers.

Texts that hold all terms come from the inverted index (rarest terms first, so a frequent term opens no candidates); only
their words are then placed. Covers come from one pass over the places of a query's terms: the least of the terms' latest
places is where the shortest stretch that ends here begins, and each begin counts once, with its first end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy as P
from . import postings
from . import search as S

STOP = tuple(sorted({*P.STOP_WORDS, *P.CLAIM_STOP_WORDS}))
WEIGHTS = {"A": 1.0, "B": 0.4}
WORD = r"[\p{L}\p{N}]+"


def stem(w: Column) -> Column:
    """A word without its plural ending: ies to y, es to e, s to nothing, but for words that only look like plurals."""
    y = w.rlike("ies$") & ~w.rlike("[ea]ies$")
    e = w.rlike("es$") & ~w.rlike("[aeo]es$")
    s = w.rlike("s$") & ~w.rlike("[us]s$")
    return F.when(y, F.regexp_replace(w, "ies$", "y")).when(e, F.regexp_replace(w, "s$", "")).when(s, F.regexp_replace(w, "s$", "")).otherwise(w)


def words(c: Column) -> Column:
    """The normalised words of a text in order, stop words included."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), F.lit(1)), stem)


def terms(c: Column, most: int = 32) -> Column:
    return F.slice(F.array_distinct(F.filter(words(c), lambda w: ~w.isin(*STOP))), 1, most)


def density(placed: Column, n_terms: Column) -> Column:
    """Score of the places (at, term from 1, inverse weight) of a query's terms in a text, in order."""
    none = F.transform(F.sequence(F.lit(1), n_terms), lambda _: F.struct(F.lit(-1).alias("at"), F.lit(0).alias("nr"), F.lit(0.0).alias("before")))
    start = F.struct(none.alias("last"), F.lit(-1).alias("begun"), F.lit(0).alias("nr"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("score"))

    def step(a, x):
        own = F.struct(x["at"].alias("at"), a["nr"].alias("nr"), a["sum"].alias("before"))
        last = F.transform(a["last"], lambda o, i: F.when(i + 1 == x["term"], own).otherwise(o))
        first = F.array_min(last)
        whole = (first["at"] >= 0) & (first["at"] > a["begun"])
        n, spread = a["nr"] - first["nr"] + 1, a["sum"] + x["inverse"] - first["before"]
        noise = x["at"] - first["at"] - (n - 1)
        return F.struct(
            last.alias("last"), F.when(whole, first["at"]).otherwise(a["begun"]).alias("begun"), (a["nr"] + 1).alias("nr"), (a["sum"] + x["inverse"]).alias("sum"), (a["score"] + F.when(whole, n / spread / (1 + noise)).otherwise(0.0)).alias("score")
        )

    return F.aggregate(placed, start, step)["score"]


def scores(queries: DataFrame, corpus: DataFrame, index: postings.Index) -> DataFrame:
    """query_id, item_id, raw of one block of queries (query_id, terms) and the texts of corpus (item_id, a, b) that hold all their terms."""
    met = postings.matching(index, queries).join(F.broadcast(queries.select("query_id", "terms")), "query_id")  # bounded by the block
    rows = met.join(corpus, "item_id")
    place = lambda c, shift, weight: F.transform(c, lambda w, i: F.struct((i + shift).alias("at"), F.array_position("terms", w).cast("int").alias("term"), F.lit(1.0 / weight).alias("inverse")))
    both = F.concat(place(F.col("a"), F.lit(0), WEIGHTS["A"]), place(F.col("b"), F.size("a"), WEIGHTS["B"]))
    rows = rows.select("query_id", "item_id", F.size("terms").alias("n"), F.filter(both, lambda x: x["term"] > 0).alias("placed"))
    return rows.select("query_id", "item_id", F.round(density(F.col("placed"), F.col("n")), 6).alias("raw"))


def search(queries: DataFrame, corpus: DataFrame, limit: int = P.SEARCH_LIMIT) -> DataFrame:
    """The best texts of corpus (item_id, described, content) for each query (query_id, terms), as rows of a source; a query without a term finds nothing."""
    known = corpus.select("item_id", words(F.col("described")).alias("a"), words(F.col("content")).alias("b"))
    index = postings.build(known.select("item_id", F.array_join(F.concat("a", "b"), " ").alias("content")))
    asked = queries.where(F.size("terms") > 0).select("query_id", "terms")
    return S.in_blocks(asked, lambda q: S.ranked(scores(q, known, index), "lexical", limit))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share all words by weight; a target stops at three times its source's size and the excess goes to the
others by weight. A source gives as many complete epochs as fit into its target. The rest comes from the documents
of least exponential key (-ln u / quality weight, u a uniform number from the document's id): sorted by that key
within the source, they are taken while their running size stays within what is left.

Running sums never put a source into one task: keys are cut into bins, bins are summed first, and only within a bin
are documents sorted.

Defined results: a null text or one without a word has size 0 and is taken with 0 words; null is a source of its
own, last in order; a source of size 0 has target 0; documents without an id share one key and are ordered by text;
repeated rows count as documents each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, spare, table

WEIGHTS, MOST, BINS = (1, 2, 3), 3, 1024


def n_words(text: str = "text") -> Column:
    """Number of words, without building them: places where a word begins."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")


def quality(text: str = "text") -> Column:
    """Weight of a document from 0.25 to 1: less for a greater share of symbols among its characters."""
    clean = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[#*$%&|<>!]+", ""))
    return F.lit(0.25) + F.lit(0.75) * clean / F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))), F.lit(1))


def uniform() -> Column:
    """A number in (0, 1) from the MD5 of the id."""
    return (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """target of each row of (source, source_size). Sources in order of their ratio of bound to weight fill up first."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    filled = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(filled), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filled), F.lit(0.0))))
    open_level = F.min(F.when(F.col("bound") / F.col("w") > F.col("level"), F.struct((F.col("bound") / F.col("w")).alias("r"), F.col("source").isNull().alias("n"), "source", "level"))).over(everything)
    return rows.withColumn("at", open_level["level"]).select("source", "source_size", F.when(F.col("at").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("at") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bins: int = BINS, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, tie of every row; weight: of a document, above 0.

    copies: how often the mix takes the document; tie: a hash of its text.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), (weight if weight is not None else quality()).alias("q"), F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("key", -F.log(uniform()) / F.col("q")).drop("q")
    rows = cut(rows.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins).cast("int")))
    by_bin = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    by_bin = cut(by_bin)
    goal = targets(by_bin.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs.cast("long")).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = by_bin.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), before.alias("before"), "n")
    edges = edges.join(goal, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    joined = rows.join(edges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")))
    whole, none = F.col("before") + F.col("n") <= F.col("left"), F.col("before") >= F.col("left")
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    plain = joined.where(whole | none).withColumn("extra", whole.cast("long"))
    cutting = joined.where(~(whole | none)).withColumn("run", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cutting = cutting.withColumn("extra", (F.col("run") + F.col("size") / 2 <= F.col("left")).cast("long")).drop("run")
    copies = F.col("epochs") + F.col("extra")
    return plain.unionByName(cutting).select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "tie")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns, each as often as it is taken.

    Documents without a word go. Rows that repeat an id, a source and a text are taken alike.
    """
    key, source, tie, copies, k = (spare(docs, n) for n in ("key", "mixed_source", "tie", "copies", "k"))
    taken = mix(docs, weights, most).where("taken > 0").groupBy(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("tie").alias(tie)).agg(F.max("copies").cast("int").alias(copies))
    found = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (F.xxhash64("text") == F.col(tie)))
    return found.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, source, tie, copies, k)


def op8_es_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies", "tie")


SQL = """
WITH d AS (
  SELECT doc_id, source, length(coalesce(text, '')) AS chars,
         length(regexp_replace(coalesce(text, ''), '[#*$%&|<>!]+', '', 'g')) AS clean,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / (0.25 + 0.75 * clean / greatest(chars, 1)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, ([1.0, 2.0, 3.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS bound FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER fill, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER fill, 0.0)) AS level
      FROM w WINDOW fill AS (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT arg_min(level, bound / w) AS opened FROM f WHERE bound / w > level),
t AS (SELECT source, source_size, CASE WHEN opened IS NULL THEN bound ELSE least(bound, opened * w) END AS target FROM f, o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.source, size, source_size, target, epochs, target - epochs * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, ((epochs + (run + size / 2.0 <= rest)::BIGINT) * size)::BIGINT AS taken FROM r
"""

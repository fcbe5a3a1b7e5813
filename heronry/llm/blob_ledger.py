"""Secret scans by an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger has one row for each pair of blob and
rule version scanned so far, with the spans found. An update scans only the pairs that the ledger lacks, each blob
once however many paths and versions hold it, and joins the findings back to all of them.

A span's place follows from the lengths of the matches and of the text between them (the text split by the same
pattern), summed up in order; offsets are code points, end exclusive.

Defined results: a null text is the empty blob, which has no span; equal texts share one blob; repeated rows and rows
without an id each get their result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping; those whose group is shorter than least characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEY = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", "[0-9a-f]{32,}", 0, 32, True),  # runs of 32 or more: the same spans as all runs without the short ones
    Rule("host_token", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
SPANS = "array<struct<start:bigint,n:int,end:bigint>>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()[:16]


def blob_id(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def _strong(r: Rule) -> Column:
    """Whether each of hits is long enough in the group that counts."""
    return F.transform("hits", lambda x: F.length(F.regexp_extract(x, r.pattern, r.group)) >= r.least)


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans of the blobs (blob, text) that have any."""
    found = F.array(*[F.struct(F.lit(n).alias("n"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("hits")) for n, r in enumerate(rules)])
    hits = blobs.withColumn("_found", found).select("blob", "text", F.explode(F.filter("_found", lambda x: F.size(x["hits"]) > 0)).alias("h")).select("blob", "text", "h.n", "h.hits")
    between = F.coalesce(*[F.when(F.col("n") == n, F.split("text", r.pattern)) for n, r in enumerate(rules)])
    strong = F.coalesce(*[F.when(F.col("n") == n, _strong(r)) for n, r in enumerate(rules)])
    sized = hits.select("blob", "n", F.arrays_zip(F.transform("hits", F.length).alias("hit"), F.transform(F.slice(between, 1, F.size("hits")), F.length).alias("gap"), strong.alias("ok")).alias("z"))
    each = sized.select("blob", "n", F.posexplode("z").alias("i", "z")).select("blob", "n", "i", "z.hit", "z.gap", "z.ok")
    so_far = Window.partitionBy("blob", "n").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(so_far)).where("ok")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("hit")).alias("start"), "n", "end"))).alias("spans"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rule_version string, spans {SPANS}")


def update(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's rows for the pairs of blob and rule version that versions (doc_id, text) has and ledger lacks."""
    version = rule_version(rules)
    # A row without an id has a name of its own, so that names are plain keys of groups and joins.
    name = F.coalesce(F.concat(F.lit("#"), F.col("doc_id").cast("string")), F.lit("")).alias("name")
    own = versions.select(name, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", blob_id())
    unseen = own.select("blob", "name").groupBy("blob").agg(F.max("name").alias("name"))  # an id before none
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    unseen = cut(unseen)
    # One row brings a blob's text: rows that repeat a name are merged, first within each task, before they meet the holders.
    blobs = own.dropDuplicates(["blob", "name"]).join(unseen, ["blob", "name"], "left_semi").select("blob", "text")
    found = _scan(blobs, rules)
    rows = unseen.select("blob").join(found, "blob", "left")
    return rows.select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", F.array().cast(SPANS)).cast(SPANS).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans of every row of versions, by the ledger's rows of these rules."""
    known = ledger.where(F.col("rule_version") == rule_version(rules)).select("blob", "spans")
    return versions.select("doc_id", blob_id().alias("blob")).join(known, "blob", "left").select("doc_id", "blob", "spans")


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["n"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256, spans."""
    base = [n for n, r in enumerate(rules) if r.base]
    spans = F.coalesce("spans", F.array().cast(SPANS))
    count = lambda n: F.size(F.filter(spans, lambda s: s["n"] == n)).cast("long")
    return found.select("doc_id", *[count(n).alias(f"n_{rules[n].kind}") for n in base], F.sha2(_joined(F.filter(spans, lambda s: s["n"].isin(base)), rules), 256).alias("base_sha256"), _joined(spans, rules).alias("spans"))


def op9_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(findings(docs, cut(update(docs))))


def _duck(n: int, r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {n} AS n, '{r.kind}' AS kind, {r.base} AS base, (list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0))::BIGINT AS start, (list_sum(gaps[1:i]) + list_sum(sizes[1:i]))::BIGINT AS stop
  FROM (SELECT doc_id, hits, [length(x) FOR x IN hits] AS sizes, [length(x) FOR x IN string_split_regex(text, '{p}')] AS gaps, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS hits FROM d) WHERE len(hits) > 0)
  WHERE length(regexp_extract(hits[i], '{p}', {r.group})) >= {r.least}"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL".join(_duck(n, r) for n, r in enumerate(RULES))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (n = {n}) AS n_{r.kind}" for n, r in enumerate(RULES) if r.base)},
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n) FILTER (base) AS base_spans,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

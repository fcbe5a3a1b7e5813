"""What ingestion makes of texts: labels, references, item types, chunks' contexts and sanitised candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy as P
from ..functions import text as T
from . import signals


def classifier_labels(classified: DataFrame, key: str, confidence: Column | None = None) -> DataFrame:
    """key, type, value, weight, confidence, source, n: labels of classified rows (key, project, task, domain, files, symbols, errors, technologies, areas).

    confidence, if given, takes the place of each type's own. n is the label's place.
    """
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    values = {
        "project": one(F.col("project")), "task_type": one(F.when(F.col("task") != "unknown", F.col("task"))), "domain": one(F.col("domain")), "file": F.col("files"), "symbol": F.col("symbols"),
        "error": F.col("errors"), "technology": F.col("technologies"), "business_area": F.col("areas"),
    }

    def label(kind: str, weight: float, sure: float):
        own = F.lit(sure) if confidence is None else confidence
        return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(weight).alias("weight"), own.alias("confidence"), F.lit("classifier").alias("source"))

    made = [F.transform(values[t], label(t, w, c)) for t, w, c in P.LABELS]
    return classified.select(key, F.posexplode(F.concat(*made)).alias("n", "l")).select(key, "l.*", "n")


def merged_labels(labels: DataFrame, key: str) -> DataFrame:
    """One label for each key, type and value in lower case: of several the heaviest, then the first (n), with the highest confidence of all."""
    best = F.max_by(F.struct("value", "weight", "source"), F.struct("weight", -F.col("n")))
    found = labels.groupBy(key, "type", F.lower("value").alias("k")).agg(best.alias("l"), F.max("confidence").alias("confidence"))
    return found.select(key, "type", "l.value", "l.weight", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))), 6).alias("confidence"), "l.source")


def enriched_labels(classified: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """Labels of a text's classification merged with those its user gave (own: key, type, value, weight). A domain the user names puts out the inferred one."""
    sure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 + F.col("confidence") * 0.4)), 6)
    given = own.select(key, "type", "value", "weight", F.lit(0.95).alias("confidence"), F.lit("prompt").alias("source"), F.lit(-1).alias("n"))
    named = own.where("type = 'domain'").select(key).distinct()
    inferred = classified.join(named.withColumn("_named", F.lit(True)), key, "left").withColumn("domain", F.when(F.col("_named").isNull(), F.col("domain")))  # each text is classified once
    kept = classifier_labels(inferred, key, sure)
    return merged_labels(given.unionByName(kept), key)


def unique_references(references: Column) -> Column:
    """References (type, uri, line_start, line_end) of a row, the first of each type, address and lines."""
    keys = F.transform(references, lambda r: F.concat_ws(":", r["type"], r["uri"], F.coalesce(r["line_start"].cast("string"), F.lit("")), F.coalesce(r["line_end"].cast("string"), F.lit(""))))
    return F.filter(references, lambda r, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def refined(items: DataFrame) -> DataFrame:
    """items (content, item_type, origin, trig, taxonomy, references, hint) with their item type: inferred only where it is the default one, memory."""
    c = F.col
    found = signals.item_type(c("content"), c("origin"), c("trig"), c("taxonomy"), c("references"), c("hint"))
    return items.withColumn("item_type", F.when(c("item_type") == "memory", found["item_type"]).otherwise(c("item_type")))


def sanitized(rows: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    """rows without those of which a text is blocked (or safety says so already), with secrets redacted and safety set."""
    clean = {c: T.redact_secrets(F.col(c)) for c in texts}
    found = rows.where(F.coalesce(F.col("safety") != "blocked", F.lit(True))).withColumns(clean)
    each = [signals.safety(F.col(c)) for c in texts]
    verdict = F.when(reduce(lambda a, b: a | b, [e == "blocked" for e in each]), "blocked").when(reduce(lambda a, b: a | b, [e == "suspicious" for e in each]), "suspicious").otherwise("safe")
    return found.withColumn("safety", verdict).where("safety <> 'blocked'")


def file_items(files: DataFrame, most: int = 512 << 10) -> DataFrame:
    """path, title, item_type, content, error of files (path, text): one item a file; what is too large or blocked carries its error in place of the content and leaves the others alone."""
    error = F.when(F.octet_length("text") > most, "too_large").when(signals.safety(F.col("text")) == "blocked", "blocked")
    made = files.select("path", "text", error.alias("error"))
    return made.select("path", T.basename(F.col("path")).alias("title"), signals.item_type_of_path(F.col("path")).alias("item_type"), F.when(F.col("error").isNull(), T.redact_secrets(F.col("text"))).alias("content"), "error")


def without_stale_sections(stored: DataFrame, kept: DataFrame) -> DataFrame:
    """stored rows (path, uri) but those of a file of kept (path, uri) whose address it no longer has; other files keep all."""
    seen = kept.select("path").distinct()
    return stored.join(seen, "path", "left_anti").unionByName(stored.join(seen, "path", "left_semi").join(kept.select("path", "uri"), ["path", "uri"], "left_semi"))

"""Scans and listings with what belongs to a row, filters, feedback streams, backups' lines and new states of relations and drafts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy as P
from ..functions import text as T
from ..functions import vectors as V


def gathered(items: DataFrame, labels: DataFrame, references: DataFrame) -> DataFrame:
    """items with their labels (item_id, type, value) and references (item_id, type, uri) as sorted JSON arrays, empty ones too."""
    own = labels.groupBy("item_id").agg(F.to_json(F.sort_array(F.collect_set(F.struct("type", "value")))).alias("labels"))
    refs = references.groupBy("item_id").agg(F.to_json(F.sort_array(F.collect_set(F.struct("type", "uri")))).alias("references"))
    return items.join(own, "item_id", "left").join(refs, "item_id", "left").withColumns({"labels": F.coalesce("labels", F.lit("[]")), "references": F.coalesce("references", F.lit("[]"))})


def chunk_candidates(chunks: DataFrame, items: DataFrame, source: str, score: Column) -> DataFrame:
    """Chunks (chunk_id, item_id) of approved items with a score and the name of the source, best first within an item."""
    j = chunks.join(items.where("status = 'approved'"), "item_id").select("chunk_id", "item_id", "project", F.lit(source).alias("source"), F.round(score, 6).alias("raw"))
    return j.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("raw").desc(), "chunk_id")))


def listed(rows: DataFrame, where: dict, newest: str, key: str, limit: int) -> DataFrame:
    """The newest rows that equal every given value; None asks for nothing."""
    kept = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in where.items() if v is not None], rows)
    return kept.orderBy(F.desc_nulls_last(newest), key).limit(limit)


def matching(rows: DataFrame, texts: tuple[str, ...], words: str) -> DataFrame:
    """rows of which one of the texts holds words, whatever the case."""
    return rows.where(F.contains(F.lower(F.concat_ws("\n", *texts)), F.lit(words.lower())))


def errors_where(logs: DataFrame, texts: tuple[str, ...] = ("message",), project: str | None = None, categories: tuple = (), severities: tuple = (), statuses: tuple = (), tag: str | None = None, words: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """logs that meet all of the filters that are given."""
    one_of = lambda c, v: F.col(c).isin(*v) if v else None
    tests = [
        F.col("project") == project if project else None, one_of("category", categories), one_of("severity", severities), one_of("status", statuses), F.exists("tags", lambda x: F.lower(x) == tag.lower()) if tag else None,
        F.contains(F.lower(F.concat_ws("\n", *texts)), F.lit(words.lower())) if words else None, F.col("last_seen") >= F.lit(since).cast("timestamp_ntz") if since else None, F.col("last_seen") <= F.lit(until).cast("timestamp_ntz") if until else None,
    ]
    return reduce(lambda d, t: d.where(t), [t for t in tests if t is not None], logs)


def feedback_streams(events: DataFrame, packs: DataFrame) -> DataFrame:
    """event_id, item_id, feedback_type, ts: what events say of single items.

    events: event_id, pack_id, feedback_type, rejected (array of items), ts; packs: pack_id, sections (JSON: items with ids in sections).
    Items named in an event get its negative kinds. All items of its pack get positive kinds, and negative ones only if none is named.
    """
    negative, known = ("rejected", "irrelevant", "stale"), ("selected", "selected_but_noisy", "rejected", "irrelevant", "stale")
    named = events.where(F.col("feedback_type").isin(*negative)).select("event_id", F.explode("rejected").alias("item_id"), "feedback_type", "ts")
    each = packs.select("pack_id", F.explode(F.from_json("sections", "array<struct<items:array<struct<id:bigint>>>>")).alias("s")).select("pack_id", F.explode("s.items").alias("i")).select("pack_id", F.col("i.id").alias("item_id"))
    whole = events.where(F.col("feedback_type").isin(*known) & (F.col("feedback_type").isin("selected", "selected_but_noisy") | (F.size("rejected") == 0)))
    return named.unionByName(whole.join(each, "pack_id").select("event_id", "item_id", "feedback_type", "ts"))


def rollup_counts(values: DataFrame, value: str, limit: int | None = None) -> DataFrame:
    """value, n: counts, the highest first, then by value."""
    n = values.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return n if limit is None else n.limit(limit)


def top_values(values: DataFrame, by: str, value: str, order: str, limit: int) -> DataFrame:
    """by, value, n: the commonest trimmed values of each group whatever their case, spelt as first seen."""
    own = values.select(by, F.btrim(F.col(value)).alias("v"), order).where("v <> ''")
    n = own.groupBy(by, F.lower("v").alias("k")).agg(F.min_by("v", order).alias("value"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "value"))
    return n.withColumn("place", place).where(F.col("place") <= limit).select(by, "value", "n")


def related(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of a and b whose values are the same once normalised as labels."""
    x, y = a.withColumn("_k", T.normalize_label(F.col(left))), b.withColumn("_k", T.normalize_label(F.col(right)))
    return x.join(y, "_k").where("_k <> ''").drop("_k")


def replaced_edges(edges: DataFrame, fresh: DataFrame, source: str, mirrored: tuple[str, ...] = ("related_to", "co_changes_with")) -> DataFrame:
    """edges (src, dst, kind, confidence, origin) in which those of one origin out of the sources of fresh are put out by fresh; kinds without direction go both ways, the surest of equal ones stays."""
    gone = fresh.select("src").distinct()
    kept = edges.where(F.col("origin") != source).unionByName(edges.where(F.col("origin") == source).join(gone, "src", "left_anti"))
    back = fresh.where(F.col("kind").isin(*mirrored)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "confidence")
    new = fresh.select("src", "dst", "kind", "confidence").unionByName(back).withColumn("origin", F.lit(source))
    return kept.unionByName(new).groupBy("src", "dst", "kind", "origin").agg(F.max("confidence").alias("confidence"))


def with_relation(edges: DataFrame, created: DataFrame, as_of: str) -> DataFrame:
    """edges with those created: they are valid from now, and a superseding one ends the inferred edges out of its target."""
    now = F.lit(as_of).cast("timestamp")
    gone = created.where("kind = 'supersedes'").select(F.col("dst").alias("src")).distinct().withColumn("_gone", F.lit(True))
    old = edges.join(gone, "src", "left").withColumn("valid_until", F.when(F.col("_gone") & F.col("inferred") & F.col("valid_until").isNull(), now).otherwise(F.col("valid_until"))).drop("_gone")
    return old.unionByName(created.withColumns({"valid_from": now, "valid_until": F.lit(None).cast("timestamp")}), allowMissingColumns=True)


def after_status(edges: DataFrame, items: DataFrame) -> DataFrame:
    """edges without the inferred ones out of items (item_id, status) that are no longer approved."""
    gone = items.where("status <> 'approved'").select(F.col("item_id").alias("src"))
    return edges.where("NOT inferred").unionByName(edges.where("inferred").join(gone, "src", "left_anti"))


def provenance(labels: DataFrame) -> DataFrame:
    """item_id, labels (type, value, weight) and provenance, a map from type:value to source and confidence, as stored in metadata."""
    key = F.concat_ws(":", "type", F.lower("value"))
    rows = labels.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("type", "value", "weight"))).alias("labels"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.struct("source", "confidence").alias("v"))))).alias("provenance"))
    return rows.withColumn("provenance", F.to_json("provenance"))


def rehydrated(stored: DataFrame) -> DataFrame:
    """Labels with their source and confidence, read back from the map in metadata; a label that the map lacks counts as of unknown source."""
    known = F.from_json("provenance", "map<string,struct<source:string,confidence:double>>")
    each = stored.select("item_id", known.alias("known"), F.explode("labels").alias("l")).select("item_id", "known", "l.type", "l.value", "l.weight")
    found = F.element_at("known", F.concat_ws(":", "type", F.lower("value")))
    return each.select("item_id", "type", "value", "weight", F.coalesce(found["source"], F.lit("unknown")).alias("source"), found["confidence"].alias("confidence"))


def resurrected(atoms: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """atoms of which the archived ones among ids (atom_id) are active again and used just now."""
    j = atoms.join(ids.select("atom_id", F.lit(True).alias("_on")), "atom_id", "left")
    back = F.coalesce(F.col("_on"), F.lit(False)) & (F.col("status") == "archived")
    return j.withColumns({"status": F.when(back, "active").otherwise(F.col("status")), "last_reused": F.when(back, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_reused").cast("timestamp_ntz"))}).drop("_on")


def backfill(items: DataFrame, dim: int, batch: int) -> DataFrame:
    """item_id, vector, batch of items (item_id, text, vector) that lack a vector: a hash embedding, in batches numbered by a hash of the id."""
    lacking = items.where("vector IS NULL").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_./:-]+)"), F.lit(1)).alias("tokens"))
    zero = F.array_repeat(F.lit(0.0), dim)

    def once(value, use):  # a lambda variable is evaluated once, a column named in a lambda again for every element
        return F.transform(F.array(value), use)[0]

    def add(a, h):
        return F.transform(a, lambda x, i: F.when(i == h["at"], x + h["sign"]).otherwise(x))

    raw = F.aggregate(F.transform("tokens", lambda t: T.hash_index(t, dim)), zero, add)
    scaled = once(raw, lambda v: once(V.norm(v), lambda n: F.transform(v, lambda x: F.round(F.when(n > 0, x / n).otherwise(0.0), 6))))
    return lacking.select("item_id", scaled.alias("vector"), F.pmod(F.xxhash64("item_id"), F.lit(batch)).alias("batch"))


def area_packs(items: DataFrame) -> DataFrame:
    """area, n, digest of items (item_id, path, content) by area: the lines of an exported pack in order of id, by their SHA-256."""
    keyed = items.select(T.area_key(F.col("path")).alias("area"), "item_id", F.sha2("content", 256).alias("h"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "h"))), lambda x: F.concat(x["item_id"].cast("string"), F.lit(" "), x["h"])), "\n")
    return keyed.groupBy("area").agg(F.count("*").alias("n"), F.sha2(lines, 256).alias("digest"))


def mirror(items: DataFrame) -> DataFrame:
    """path, digest: a Markdown file for each item (item_id, project, item_type, title, content), headed by its fields."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", "-"), "^-|-$", "")
    path = F.concat("project", F.lit("/"), "item_type", F.lit("/"), slug, F.lit("-"), F.col("item_id").cast("string"), F.lit(".md"))
    text = F.concat(F.lit("---\nid: "), F.col("item_id").cast("string"), F.lit("\ntype: "), "item_type", F.lit("\n---\n# "), "title", F.lit("\n\n"), "content", F.lit("\n"))
    return items.select(path.alias("path"), F.sha2(text, 256).alias("digest"))


def git_files(lines: DataFrame) -> DataFrame:
    """path, status, prior of records of a diff between commits (line: status and paths, each ended by a zero byte); renamings carry a similarity."""
    parts = F.split("line", "\\x00")
    kind = F.substring(F.get(parts, F.lit(0)), 1, 1)
    two = kind.isin("R", "C")
    status = F.when(kind == "A", "added").when(kind == "D", "deleted").when(kind == "R", "renamed").when(kind == "C", "added").otherwise("changed")
    similar = F.when(two, F.expr("try_cast(substring(split(line, '\\\\x00')[0], 2) AS int)"))
    return lines.select(F.when(two, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), status.alias("status"), F.when(kind == "R", F.get(parts, F.lit(1))).alias("prior"), similar.alias("similarity")).where("path <> ''")


def redacted_atoms(atoms: DataFrame) -> DataFrame:
    """atoms with secrets taken out of the claim, the evidence, the triggers and the pitfalls."""
    clean = lambda c: F.transform(c, T.redact_secrets)
    return atoms.withColumns({"claim": T.redact_secrets(F.col("claim")), "evidence": clean("evidence"), "triggers": clean("triggers"), "pitfalls": clean("pitfalls")})


def legacy_factor(status: Column) -> Column:
    """What a score is multiplied with by legacy status: null for what is dropped."""
    return F.when(status == "legacy_archived", None).when(status == "legacy_replaced", P.LEGACY_FACTOR).otherwise(1.0)

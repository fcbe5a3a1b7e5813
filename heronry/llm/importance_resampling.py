"""Importance resampling towards a target distribution, with hashed n-grams read by a vectorised byte automaton.

The texts of an Arrow batch are one buffer of UTF-8 bytes. A lookup table lower-cases A-Z, another one tells bytes of
words from the rest, and word boundaries are where that class differs from its neighbour's (or a document begins). The
CRC-32 of all words of a stretch is then advanced by one byte a step, all starts at once: words are in order of length,
so those that still have a byte are a prefix. Runs of two and three words go on from the state of the run before them,
through a space and the next word. A byte beyond the LONG-th of a word goes through zlib, so a word of any length costs
time in proportion to its bytes.

A first pass counts buckets of documents and of the target, a second one weighs every document by the gains of its
buckets; only the gains (one number for each bucket) travel. Draws are the highest scores with Gumbel noise, so they are
a sample without replacement in proportion to exp(weight). Ranks come from one range-partitioned sort of score rows.

Defined results: a null or empty text has no features and weight 0; a null doc_id has the noise of an empty id and comes
last among ties; repeated rows are ranked one after another; a very long text is read in stretches of STRETCH words; an
empty table gives an empty result, an empty target gives gains from document counts alone; extra columns are ignored
(drawn carries them).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Words whose CRCs advance together, bytes of texts that are classified together, and bytes of a word read step by step.
STRETCH, PIECE, LONG = 1 << 16, 4 << 20, 48

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words after lower-casing: digits, a-z, and every byte of a character beyond ASCII.
WORD = np.zeros(256, np.int8)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[128:] = 1


def _crc_table() -> np.ndarray:
    """The effect of each byte on a CRC-32 state, by eight steps of the reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


STEP = _crc_table()
FRESH = np.uint32(0xFFFFFFFF)


def words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word of lower-cased bytes; document i is data[edges[i]:edges[i + 1]]."""
    inside = WORD[data]
    change = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    joints = np.unique(edges[(edges > 0) & (edges < len(data))])
    joints = joints[(inside[joints] == 1) & (inside[joints - 1] == 1)]
    if len(joints):
        starts, ends = np.sort(np.concatenate([starts, joints])), np.sort(np.concatenate([ends, joints]))
    return starts, ends, np.searchsorted(edges, starts, "right") - 1


def _advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, active: np.ndarray) -> np.ndarray:
    """States after the bytes of each word. order: words by falling length; active[k]: how many have a k-th byte."""
    s, at = state[order], starts[order]
    for k in range(min(len(active), LONG)):
        n = active[k]
        s[:n] = STEP[s[:n].astype(np.uint8) ^ data[at[:n] + k]] ^ (s[:n] >> np.uint32(8))
    if len(active) > LONG:
        for i in range(active[LONG]):
            tail = data[starts[order[i]] + LONG : ends[order[i]]]
            s[i] = zlib.crc32(tail, int(s[i] ^ FRESH)) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, run: int = RUN):
    """(crc, document) arrays of all runs of 1 to run words, stretch by stretch."""
    for lo in range(0, len(starts), STRETCH):
        a = max(0, lo - run + 1)
        s, e, d = starts[a : lo + STRETCH], ends[a : lo + STRETCH], doc[a : lo + STRETCH]
        length = e - s
        order = np.argsort(-length, kind="stable")
        active = len(s) - np.cumsum(np.bincount(length))[:-1]
        state = None
        for n in range(run):
            if state is None:
                before, ok = np.full(len(s), FRESH), np.ones(len(s), bool)
            else:
                shifted = np.concatenate([[FRESH], state[:-1]])
                before = STEP[shifted.astype(np.uint8) ^ np.uint8(32)] ^ (shifted >> np.uint32(8))
                ok = np.zeros(len(s), bool)
                ok[n:] = d[n:] == d[:-n]
            state = _advance(before, data, s, e, order, active)
            ok[: lo - a] = False
            yield state[ok] ^ FRESH, d[ok]


def stretches(column: pa.Array):
    """(first row, lower-cased bytes, edges) of slices of a string column, PIECE bytes or one row at a time, straight from its buffers."""
    wide = pa.types.is_large_string(column.type)
    edges = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(edges, edges[row] + PIECE, "right")) - 1)
        yield row, LOWER[data[edges[row] : edges[to]]], edges[row : to + 1] - edges[row]
        row = to


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)


def bucket_counts(df: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends its own counts, never its features."""

    def count(batches):
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, edges in stretches(batch.column(0)):
                for crc, _ in features(data, *words(data, edges), run):
                    found += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(found[own])], names=["bucket", "n"])

    rows = _texts(df).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # one row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed ratio of shares, for each bucket."""
    k, s_all, t_all = len(own), int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = np.uint32(len(gain))

    def weigh(batches):
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, data, edges in stretches(batch.column(0)):
                n, found = len(edges) - 1, words(data, edges)
                n_words[row : row + n] = np.bincount(found[2], minlength=n)
                for crc, doc in features(data, *found, run):
                    n_features[row : row + n] += np.bincount(doc, minlength=n)
                    weight[row : row + n] += np.bincount(doc, gain[crc % buckets], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return _texts(docs, "doc_id").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Noise in thousandths, the same for an id in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _placed(rows: DataFrame) -> DataFrame:
    """rows with their place (1, 2, 3 ...) by falling score, ties by doc_id: a range-partitioned sort, then the rows of the parts before."""
    inside = 1 << 33
    ordered = rows.withColumn("at", F.monotonically_increasing_id())
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("at")]
    ordered = cut(ordered.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("at").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, so_far = [], 0
    for number, n in sizes:
        before += [F.lit(number), F.lit(so_far)]
        so_far += n
    if not before:
        return ordered.withColumn("place", F.lit(None).cast("long"))
    return ordered.withColumn("place", F.col("place") % inside + 1 + F.element_at(F.create_map(*before), part).cast("long"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn), n_words of every row of docs (doc_id, text); target has texts."""
    gain = gains(bucket_counts(docs, buckets, run), bucket_counts(target, buckets, run))
    scored = cut(weights(docs, gain, run).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    may = scored.where(F.col("n_words") >= least_words)
    most = percent * may.count() // 100
    ranked = _placed(may).withColumn("rank", F.when(F.col("place") <= most, F.col("place"))).drop("place")
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def drawn(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of docs whose doc_id is drawn, with all their columns; rows that share a drawn id stay together."""
    ids = cut(resampled(docs, target, **parameters).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct())
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("drawn_id")), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FEATURES = r"""
    SELECT r, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]), list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]))) AS f
    FROM (SELECT r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM {0})
"""
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
marks AS (SELECT row_number() OVER () AS r, text FROM benchmark),
own AS ({_FEATURES.format("docs")}),
aim AS ({_FEATURES.format("marks")}),
bits AS (
    SELECT f, flatten(list_transform(range(0, octet_length(encode(f))), lambda i: list_transform(range(0, 8), lambda k: (('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT >> k) & 1))) AS b
    FROM (SELECT f FROM own UNION SELECT f FROM aim)
),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 1, 3988292384::BIGINT * (xor(c, x) & 1))), 4294967295::BIGINT) % 10000 AS bucket FROM bits),
own_n AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (f) GROUP BY bucket),
aim_n AS (SELECT bucket, count(*) AS n FROM aim JOIN hashed USING (f) GROUP BY bucket),
gain AS (
    SELECT o.bucket, floor(1000 * ln((coalesce(a.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM own_n) + 10000)::DOUBLE / ((o.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM aim_n) + 10000)::DOUBLE)))::BIGINT AS g
    FROM own_n o LEFT JOIN aim_n a USING (bucket)
),
weighed AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS weight FROM own JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY r),
counted AS (SELECT r, count(*) AS n_words FROM own WHERE NOT contains(f, ' ') GROUP BY r),
scored AS (
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM docs LEFT JOIN weighed USING (r) LEFT JOIN counted USING (r)
),
placed AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank, n_words FROM placed
"""

"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each majority among the 64-bit hashes of a text's word shingles. For radius r, every
bit position carries a vector of r + 1 bits; each of the 2**(r+1) - 1 nonzero vectors v gives the mask of the
positions whose vector has an odd product with v. Up to r differing positions always leave some v orthogonal to
them all, so that mask hides every difference: each pair within the radius meets in some table, with no chance of
a miss.

Equal fingerprints are one node. Nodes that share a masked value are compared in full; of a bucket's links only a
spanning forest is kept, so no group of copies is expanded into pairs. Buckets of more than BUCKET nodes are cut
into blocks while they are read, and every two blocks are compared by themselves.

Defined results: a null text or one without a word has fingerprint zero and links like any other; a component's id
is its least doc_id that is not null (null if there is none); repeated rows and ties share fingerprint and
component; a very long text is hashed in stretches of 32,768 words; an empty table gives an empty result; extra columns are ignored
(keep_one carries them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, spare, table
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
BUCKET = 2048


def masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask for each nonzero vector; position i carries the vector 1 + i mod (2**(radius+1) - 1)."""
    size = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(64) if bin((1 + i % size) & v).count("1") % 2) for v in range(1, size + 1)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else None
    bits, n = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_digest
    for at in range(0, 1 if parts else len(words) - shingle + 1, 1 << 15):
        own = words[at : at + (1 << 15) + shingle - 1]
        found = parts or [b" ".join(x) for x in zip(*(own[k:] for k in range(shingle)))]
        raw = np.frombuffer(b"".join([digest(x, SEED) for x in found]), np.uint8).reshape(-1, 8)
        bits += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
        n += len(found)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the fingerprint as a signed long, and the SHA-256 of the text (null: of the empty one)."""

    def run(batches):
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            found = np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array([hashlib.sha256((x or "").encode()).digest() for x in texts], pa.binary())], names=["doc_id", "fp", "sha"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, sha binary")


def _near(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the links between a and b (all within one array if same).

    The forest is grown outwards: what a fingerprint reaches leaves the pool it is compared with, so a group of
    near copies costs one comparison for each of them, not for each pair.
    """
    sides = (a, a) if same else (a, b)
    shift = 0 if same else len(a)
    pools = [np.arange(len(a)), np.arange(len(b))]  # not yet reached
    if same:
        pools[1] = pools[0]
    left, right = [], []
    while len(pools[0]) and (same or len(pools[1])):
        seed, pools[0] = int(pools[0][0]), pools[0][1:]
        todo = [(0, seed)]
        while todo:
            side, i = todo.pop()
            other = 0 if same else 1 - side
            pool = pools[other]
            near = np.bitwise_count(sides[other][pool] ^ sides[side][i]) <= radius
            if near.any():
                found = pool[near]
                pools[other] = pool[~near]
                left.append(np.full(len(found), i + shift * side))
                right.append(found + shift * other)
                todo += [(other, int(j)) for j in found]
    nothing = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (nothing, nothing)


def _links(radius: int, bucket: int):
    """Reads rows (t, key, fp) sorted by t and key. Gives edges, or packed blocks of a bucket that is too large."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("t", pa.int32()), ("key", pa.int64()), ("block", pa.int32()), ("data", pa.binary())])

    def edges(fp):
        i, j = _near(fp.view(np.uint64), fp[:0].view(np.uint64), radius, True)
        return fp[i], fp[j]

    def linked(fp):
        u, v = edges(fp)
        k = len(u)
        if k:
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)

    def packed(t, key, block, part):
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([t], pa.int32()), pa.array([key], pa.int64()), pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema)

    def run(batches):
        # The bucket being read: t, key, blocks sent off so far, and what is left, never much more than a batch.
        at, sent, left = None, 0, np.zeros(0, np.int64)

        def finish():
            if sent and len(left):
                yield packed(*at, sent, left)
            elif len(left) > 1:
                yield from linked(left)

        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, fp = (batch.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
            for s, e in zip(starts, np.r_[starts[1:], len(t)]):
                if at == (t[s], key[s]):
                    left = np.concatenate([left, fp[s:e]])
                else:
                    yield from finish()
                    at, sent, left = (t[s], key[s]), 0, fp[s:e].copy()
                while len(left) > bucket:
                    yield packed(*at, sent, left[:bucket])
                    sent, left = sent + 1, left[bucket:]
        yield from finish()

    return run, "u long, v long, t int, key long, block int, data binary"


def _block_pairs(radius: int):
    def run(batches):
        for batch in batches:
            for a, b, same in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                i, j = _near(x.view(np.uint64), y.view(np.uint64), radius, same)
                both = x if same else np.concatenate([x, y])
                yield pa.RecordBatch.from_arrays([pa.array(both[i]), pa.array(both[j])], names=["u", "v"])

    return run, "u long, v long"


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges u, v between distinct fingerprints (column fp) that connect all that are within the radius."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key")).select("t", "key", "fp")
    run, schema = _links(radius, bucket)
    found = cut(keyed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, schema))
    small, blocks = found.where("u is not null").select("u", "v"), found.where("u is null").drop("u", "v")
    if blocks.isEmpty():
        return small
    # Numbers of blocks meet first; their data joins each pair of numbers by bucket and block, so a large bucket's pairs are spread over tasks.
    ends = blocks.groupBy("t", "key").agg(F.max("block").alias("last"))
    pairs = ends.select("t", "key", "last", F.explode(F.sequence(F.lit(0), "last")).alias("x")).repartition("t", "key", "x").select("t", "key", "x", F.explode(F.sequence("x", "last")).alias("y"))
    side = lambda n, to: blocks.select("t", "key", F.col("block").alias(n), F.col("data").alias(to))
    pairs = pairs.join(side("x", "a"), ["t", "key", "x"]).join(side("y", "b"), ["t", "key", "y"]).select("a", "b", (F.col("x") == F.col("y")).alias("same"))
    run, schema = _block_pairs(radius)
    return small.union(pairs.mapInArrow(run, schema))


def _components(docs: DataFrame, shingle: int, radius: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, sha of every row; fp, root, component_id of every fingerprint)."""
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes.select("fp"), radius, bucket))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, rooted.join(least, "root").select("fp", "root", "component_id")


def near_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints, of_fp = _components(docs, shingle, radius, bucket)
    return prints.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row of docs for each component, with all its columns: that of the least doc_id (null last), then of the least SHA-256."""
    prints, of_fp = _components(docs, shingle, radius, bucket)
    own, key, sha = spare(docs, "own"), spare(docs, "key"), spare(docs, "sha")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")).alias("first")
    stays = cut(prints.join(of_fp, "fp").groupBy("root").agg(first, F.count("*").alias("n")).select(F.col("first.doc_id").alias(key), F.col("first.sha").alias(sha)))
    kept = docs.withColumn(own, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    kept = kept.join(stays, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha)), "left_semi")
    again = prints.groupBy("doc_id", "sha").count().where("count > 1")
    return (kept if again.isEmpty() else kept.dropDuplicates(["doc_id", own])).drop(own)


def op5_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


SQL = None  # DuckDB has no XXH64 of a given seed; tests hold it against all pairs

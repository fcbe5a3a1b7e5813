"""Exact duplicates by composable polynomial fingerprints.

A text is lower-cased (A-Z only) and read as UTF-8 in fixed chunks. Each chunk has a polynomial hash modulo two
primes; the hash of a concatenation follows from the hashes of its parts by a length shift
(h(ab) = h(a) * B**len(b) + h(b)), so a document is hashed chunk by chunk, all within its row's task, and combined. Texts whose
fingerprint and length agree are then compared chunk by chunk: for every chunk position the least and the greatest
chunk of the group are kept while rows stream by, and the group is one text exactly if they agree everywhere.
A fingerprint that fails is split by SHA-256.

Defined results: a null text counts as empty; empty texts equal each other; a null doc_id never wins against one
that is not null; of rows that repeat the winning doc_id just one is kept; an empty table gives an empty result;
extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, spare, table

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 999979)
CHUNK = 1 << 14

_POWERS: dict[int, np.ndarray] = {}


def _powers(j: int) -> np.ndarray:
    """B**(CHUNK-1) ... B**0 modulo the j-th prime."""
    if j not in _POWERS:
        out, x = [], 1
        for _ in range(CHUNK):
            out.append(x)
            x = x * BASES[j] % PRIMES[j]
        _POWERS[j] = np.array(out[::-1], np.uint64)
    return _POWERS[j]


def chunk_hashes(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(hash, hash, length) of each chunk of data."""
    out = []
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
        out.append((*(int((part * _powers(j)[CHUNK - len(part) :]).sum() % np.uint64(PRIMES[j])) for j in (0, 1)), len(part)))
    return out


def combine(parts: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Hash of the concatenation of parts. Associative, so parts may be combined in any grouping."""
    a = b = n = 0
    for x, y, length in parts:
        a = (a * pow(BASES[0], length, PRIMES[0]) + x) % PRIMES[0]
        b = (b * pow(BASES[1], length, PRIMES[1]) + y) % PRIMES[1]
        n += length
    return a, b, n


def fingerprint(data: bytes) -> tuple[int, int]:
    """(both hashes in one 62-bit number, length in bytes)."""
    a, b, n = combine(chunk_hashes(np.frombuffer(data, np.uint8)))
    return a << 31 | b, n


def _prints(batches):
    for batch in small(batches):
        texts = [(x or "").encode().lower() for x in batch.column(1).to_pylist()]
        fp = [fingerprint(x) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in fp], pa.int64()), pa.array([x[1] for x in fp], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())],
            names=["doc_id", "fp", "n_bytes", "sha"],
        )


def _chunks(batches):
    for batch in small(batches):
        rows = ([], [], [], [])
        held = 0
        for x in batch.column(0).to_pylist():
            data = (x or "").encode().lower()
            fp, n = fingerprint(data)
            for k, at in enumerate(range(0, n, CHUNK)):
                for out, v in zip(rows, (fp, n, k, data[at : at + CHUNK]), strict=True):
                    out.append(v)
            held += n
            if held > 4 << 20:
                yield _chunk_batch(rows)
                rows, held = ([], [], [], []), 0
        yield _chunk_batch(rows)


def _chunk_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary())], names=["fp", "n_bytes", "k", "chunk"])


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_prints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, n_bytes long, sha binary")
    prints = cut(prints.withColumn("row", F.monotonically_increasing_id()))
    compared = (
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(_chunks, "fp long, n_bytes long, k int, chunk binary")
        .groupBy("fp", "n_bytes", "k")
        .agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    )
    differ = compared.where(F.col("lo") != F.col("hi")).select("fp", "n_bytes").distinct()
    differ = cut(differ)
    if differ.isEmpty():
        split = prints.withColumn("part", F.lit(b""))
    else:
        split = prints.join(differ.withColumn("bad", F.lit(True)), ["fp", "n_bytes"], "left").withColumn("part", F.when(F.col("bad"), F.col("sha")).otherwise(F.lit(b"")))
    best = split.groupBy("fp", "n_bytes", "part").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best"))
    return split.join(best, ["fp", "n_bytes", "part"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, one for each distinct text, with all columns of docs."""
    marks = cut(exact_dedup(docs).select("doc_id", "keep_id", "kept", "text_sha256"))
    own, key, sha = spare(docs, "own"), spare(docs, "key"), spare(docs, "sha")
    stays = marks.where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = docs.withColumn(own, F.sha2(lower, 256))
    kept = kept.join(stays, F.col(key).eqNullSafe(F.col("doc_id")) & (F.col(sha) == F.col(own)), "left_semi")
    repeats = marks.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept"))
    return (kept if repeats.isEmpty() else kept.dropDuplicates([own])).drop(own)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

"""Quality classification by compression.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled bad. Every text is
compressed with either, in pieces short enough for the dictionary to matter. The normalised difference of the two
compressed sizes, calibrated on labelled rows that trained neither dictionary, is the score.

Learning takes at most SAMPLE rows of each label, each with its whole text. Defined results: a null or empty text has difference 0 and gets
the score the calibration gives to 0; with one label or none learned, every score is the share of good rows learned
(0.5 with none); rows without an id are scored but neither held out nor learned from; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold_crc, small, table

SAMPLE = 600
DICTIONARY, LEVEL, PIECE = 32 << 10, 3, 500
THRESHOLD = 0.3


def _piece(data: bytes, at: int) -> bytes:
    return data[at : at + PIECE]


class Model:
    """good, bad: dictionary bytes; curve: increasing differences and their scores."""

    def __init__(self, good: bytes, bad: bytes, curve: tuple[np.ndarray, np.ndarray]):
        self.good, self.bad, self.curve = good, bad, curve

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "curve": self.curve}

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        """Bytes under the good and the bad dictionary, and uncompressed."""
        if "tools" not in self.__dict__:
            self.tools = []
            for x in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(x)
                d.precompute_compress(level=LEVEL)
                self.tools.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        data = (text or "").encode()
        a = b = 0
        for at in range(0, len(data), PIECE):
            x = _piece(data, at)
            a, b = a + len(self.tools[0](x)), b + len(self.tools[1](x))
        return a, b, len(data)

    def difference(self, text: str | None) -> float:
        """Bytes that the good dictionary saves over the bad one for each byte of text."""
        if not self.good or not self.bad:
            return 0.0
        a, b, n = self.sizes(text)
        return (b - a) / n if n else 0.0

    def score(self, text: str | None) -> float:
        return float(np.interp(self.difference(text), *self.curve))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing step means of y over sorted x (pool adjacent violators), smoothed by one pseudo-row at the base rate."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, rows
    base = float(y.mean())
    for k in order:
        blocks.append([float(x[k]), float(y[k]), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
    at = np.array([b[0] / b[2] for b in blocks])
    to = np.array([(b[1] + base) / (b[2] + 1) for b in blocks])
    return at, np.maximum.accumulate(to)


def fit(texts: list[str], labels: list[int]) -> Model:
    y = np.array(labels, float)
    rate = float(y.mean()) if len(y) else 0.5
    flat = (np.array([0.0]), np.array([rate]))
    if rate in (0.0, 1.0) or not len(y):
        return Model(b"", b"", flat)
    own = {v: [t.encode() for t, l in zip(texts, labels, strict=True) if l == v] for v in (0, 1)}
    halves = {v: (t[::2], t[1::2]) for v, t in own.items()}
    made = {}
    for v in (0, 1):
        pieces = [_piece(t, at) for t in halves[v][0] for at in range(0, len(t), PIECE)]
        made[v] = _dictionary(pieces)
    model = Model(made[1], made[0], flat)
    rest = [(t.decode(), v) for v in (0, 1) for t in (halves[v][1] or halves[v][0])]
    x = np.array([model.difference(t) for t, _ in rest])
    z = np.array([float(v) for _, v in rest])
    at, to = isotonic(x, z)
    if math.isfinite(at.sum()) and len(at):
        model.curve = (at, to)
    return model


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary with the class's entropy tables; plain content where there is too little text to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:] or b" "


def learn(docs: DataFrame, labels: DataFrame, eligible) -> Model:
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("_label")).where(eligible & F.col("_label").isin(0, 1)).groupBy("doc_id").agg(F.min("_label").alias("_label"))
    chosen = bounded_sample(marks, "_label", SAMPLE).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "_label").agg(F.min("text").alias("text")).select("text", "_label").orderBy(F.xxhash64("text"), "text").toArrow()
    return fit(rows["text"].to_pylist(), rows["_label"].to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of docs with doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in small(batches):
            found = [own.score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64()), pa.array([int(x >= THRESHOLD) for x in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(fold_crc("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op6_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, learn(docs, labels, F.coalesce(fold_crc("doc_id", 5) != 0, F.lit(False))))


SQL = None  # no SQL form; tests measure held-out accuracy

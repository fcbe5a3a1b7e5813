"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary classifier over hashed byte n-grams (smoothed log odds) tells
the languages with a 1 from those with a 0. A text's margins are held against all codewords; a bit that tells its
two sides apart better counts more; the codeword of least weighted logistic loss wins. A text whose runner-up is
close is flagged as ambiguous.

Learning takes at most SAMPLE documents of a language and SAMPLES in all. Defined results: a null text or one
without a letter is `und` with score 0; with no labelled row every text is `und`; a single learned language is
predicted for every text with a letter; rows without an id are predicted but neither held out nor learned from;
repeated rows get equal results; a very long text is read in pieces of PIECE bytes; columns whose names are those of the results are
kept by `identified` and replaced by `identify`; other extra columns are carried.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fold_crc, small, spare, table

SAMPLE, SAMPLES = 400, 4000
GRAMS = (1, 2, 3)
BUCKETS = 1 << 15
#: n-grams beyond this many add no more confidence to a text.
TRUSTED = 60
#: A text is ambiguous if its language's share of the decoded belief is below this.
CLEAR = 0.6
PIECE = 1 << 20

_LETTER = regex.compile(r"\p{L}").search
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all splits of up to 5 languages, else the best spread of a few seeded draws."""
    if n <= 5:
        return np.array([[1 if k == 0 else (1 if bits[k - 1] else -1) for bits in itertools.product((0, 1), repeat=n - 1) if not all(bits)] for k in range(n)], np.float32).reshape(n, -1)
    best, spread, rng = None, -1, np.random.default_rng(5)
    width = max(15, 4 * math.ceil(math.log2(n)))
    for _ in range(100):
        drawn = rng.choice(np.array([-1, 1], np.float32), (n, width))
        drawn[0, np.abs(drawn.sum(0)) == n] *= -1
        gap = min(int((drawn[a] != drawn[b]).sum()) for a, b in itertools.combinations(range(n), 2))
        if gap > spread:
            best, spread = drawn, gap
    return best


def gram_buckets(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that begins at each byte, for each n; bytes that are no letters count as space."""
    x = _KEEP[data].astype(np.uint32)
    out = []
    for n in GRAMS:
        h = np.full(max(0, len(x) - n + 1), n, np.uint32)
        for k in range(n):
            h = (h ^ x[k : k + len(h)]) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
        out.append(h & np.uint32(BUCKETS - 1))
    return out


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, slope: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.slope, self.trust = languages, code, weights, slope, trust

    def margins(self, text: str) -> tuple[np.ndarray, int]:
        """Mean log odds of each bit over the text's n-grams, and how many n-grams hold a letter."""
        data = np.frombuffer(text.lower().encode(), np.uint8)
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in range(0, len(data), PIECE):
            for h in gram_buckets(data[at : at + PIECE + max(GRAMS) - 1]):
                total += np.bincount(h, minlength=BUCKETS).astype(np.float32) @ self.weights if len(h) > 4096 else self.weights[h].sum(0)
            n += int((_KEEP[data[at : at + PIECE]] != 0x20).sum())
        return total / max(1, n), n

    def belief(self, text: str) -> np.ndarray:
        m, n = self.margins(text)
        z = self.code * (m * self.slope * math.sqrt(min(n, TRUSTED)))
        loss = (self.trust * np.logaddexp(0, -z)).sum(1)
        p = np.exp(loss.min() - loss)
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER(text):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        p = self.belief(text)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < CLEAR)


def fit(texts: list[str], langs: list[str]) -> Model:
    languages = sorted(set(langs))
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), 0)), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    code = codewords(len(languages))
    counts = np.zeros((len(languages), BUCKETS))
    for text, lang in zip(texts, langs, strict=True):
        for h in gram_buckets(np.frombuffer(text.lower().encode(), np.uint8)):
            counts[languages.index(lang)] += np.bincount(h, minlength=BUCKETS)
    share = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True)
    blank = np.unique([int(h[0]) for h in gram_buckets(np.full(max(GRAMS), 0x20, np.uint8))])
    weights = np.stack([np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1)
    weights[blank] = 0
    model = Model(languages, code, weights.astype(np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))
    m = np.array([model.margins(t)[0] for t in texts])
    want = code[[languages.index(x) for x in langs]]
    model.slope = 1 / np.maximum(np.abs(m).mean(0), 1e-6)
    right = ((m * want > 0).sum(0) + 1) / (len(texts) + 2)
    model.trust = np.log(right / (1 - right)).clip(0.05, 6)
    model.trust /= model.trust.mean()
    return model


def learn(docs: DataFrame, eligible: Column) -> Model:
    """Fit to a bounded sample of the eligible rows that have a language."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(eligible & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = max(1, rows.select("lang").distinct().count())
    sample = bounded_sample(rows, "lang", max(20, min(SAMPLE, SAMPLES // n))).select("text", "lang").orderBy("lang", "text").toArrow()
    return fit(sample["text"].to_pylist(), sample["lang"].to_pylist())


RESULTS = ("lang_pred", "score", "ambiguous")


def identify(docs: DataFrame, model: Model, results: tuple[str, str, str] = RESULTS) -> DataFrame:
    """docs with lang_pred, score and ambiguous, under the names in results, which take the place of columns of docs so called."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in small(batches):
            found = [own.predict(x) for x in batch.column(0).to_pylist()]
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], *results])

    kept = docs.drop(*results)
    rows = kept.select(F.col("text").cast("string").alias(spare(kept, "text")), *[F.col(f"`{c}`") for c in kept.columns])
    kinds = zip(results, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)
    return rows.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(n, k) for n, k in kinds]]))


def identified(docs: DataFrame, model: Model | None = None, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs whose language the model can tell, with the columns of docs; a null lang becomes the predicted one.

    Rejected are texts that are `und`, texts whose runner-up is close (ambiguous), and, if languages are named, those of
    another language. Without a model, one is learned from docs; if it has nothing to learn from, only texts that have no
    letter go, as nothing can be told of the others.
    """
    model = model or learn(docs, F.coalesce(fold_crc("doc_id", 4) != 2, F.lit(False)))
    names = [spare(docs, n) for n in RESULTS]
    told, ambiguous = F.col(names[0]), F.col(names[2])
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = identify(docs, model, tuple(names)).where((told != "und") & ~ambiguous)
    if languages:
        kept = kept.where(told.isin(*languages))
    own = {c: F.coalesce(F.col("lang").cast("string"), told).alias(c) if c.lower() == "lang" and docs.schema[c].dataType == T.StringType() else F.col(f"`{c}`") for c in docs.columns}
    return kept.select(*own.values())


def held_out() -> Column:
    return F.coalesce(fold_crc("doc_id", 4) == 2, F.lit(False))


def op3_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, F.coalesce(fold_crc("doc_id", 4) != 2, F.lit(False)))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify_slim(rows, model)


def identify_slim(rows: DataFrame, model: Model) -> DataFrame:
    """As identify, for rows of doc_id, text and held_out, without sending the text back."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in small(batches):
            found = [own.predict(x) for x in batch.column(1).to_pylist()]
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col("text").cast("string").alias("text"), "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


SQL = None  # no SQL form; tests measure held-out accuracy

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from heronry.llm import importance_resampling as M

from ..differential import duck, rows

ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_features(text, run=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ABC))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20):
    """Per row in the order given: n_features, weight, score, rank."""
    found = [(i, *brute_features(t)) for i, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own, aim = Counter(bucket(f) for _, _, fs in found for f in fs), Counter(bucket(f) for t in target for f in brute_features(t)[1])
    s, t = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in own}
    out = []
    for i, n, fs in found:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return sorted(([i, n, w, s, k] for i, _, n, w, s, k in out), key=str)


def got(df):
    return sorted(([r.doc_id, r.n_features, r.weight, r.score, r.rank] for r in df.collect()), key=str)


def test_query(spark, sf_dir, documents):
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(M.op11_importance_resampling(spark, sf_dir)) == brute(documents, target)


def test_sql(spark, sf_dir):
    assert rows(M.op11_importance_resampling(spark, sf_dir)) == duck(sf_dir, M.SQL)


def test_automaton_by_stretches(monkeypatch):
    """Words over LONG bytes, documents that end and begin within a word, empty documents, and stretches of three words."""
    texts = ["Ab cd-ef", "", "gh", "é" * 90 + " x" + "y" * 200, "A b C d 9 e", "tail", "\x00nul\x7f東京 z"]
    raw = [t.translate(ABC).encode() for t in texts]
    data, edges = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = sorted((zlib.crc32(f.encode()), i) for i, t in enumerate(texts) for f in brute_features(t)[1])
    for size in (1, 2, 3, 1000):
        monkeypatch.setattr(M, "STRETCH", size)
        found = [(int(c), int(d)) for crc, doc in M.features(data, *M.words(data, edges)) for c, d in zip(crc, doc, strict=True)]
        assert sorted(found) == want


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("words and more words here",), (None,), ("",)], "text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()] * 3
    many = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert got(M.resampled(many, target, percent=50)) == brute(docs, [r.text for r in target.collect()], percent=50)
    assert M.resampled(none, target).count() == 0
    assert got(M.resampled(odd, target.limit(0))) == brute([(r.doc_id, r.text) for r in odd.collect()], [])
    kept = M.drawn(odd, target, percent=100, least_words=10)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 1, 5, 7, 8, None}


def test_a_very_long_text(spark):
    text = " ".join(f"Word{k % 977}" for k in range(130_000)) + " " + "q" * 200_000
    docs = [(1, text), (2, "short one"), (3, "ring " * 30)]
    assert got(M.resampled(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("ring ring",)], "text string"), percent=60)) == brute(docs, ["ring ring"], percent=60)

import hashlib
from collections import Counter

from heronry.llm import countmin_spans as M


def brute(docs, window=35):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    n = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - window + 1) if n[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_query(spark, sf_dir, documents):
    assert found(M.op7_countmin_spans(spark, sf_dir)) == brute(documents)


def test_odd_rows(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for window in (3, 35):
        assert found(M.repeated_spans(odd, window)) == brute(docs, window)
    assert M.repeated_spans(none).count() == 0


def test_many_blocks(spark, documents):
    """Sketch and exact pass agree with brute force when the key space has several blocks and packs are small."""
    from heronry.llm import exchange

    docs = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(6)
    whole = exchange.block_bits
    M.block_bits = lambda units: 3
    try:
        assert found(M.repeated_spans(docs, 8)) == brute(documents, 8)
    finally:
        M.block_bits = whole

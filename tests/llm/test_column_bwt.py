import hashlib
import random

import pytest

from heronry.llm import column_bwt as M


def brute(docs, length=100):
    """docs in order."""
    seen, out = set(), []
    for i, t in docs:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            w = x[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(x)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(x), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_construct():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(12))) for _ in range(40)]
    who, at = M.construct(texts)
    want = sorted((texts[i][k:], i, k) for i in range(40) for k in range(len(texts[i]) + 1))
    assert [texts[i][k:] for i, k in zip(who, at)] == [w[0] for w in want] and len(who) == len(want)


def test_query(spark, sf_dir, documents):
    assert found(M.op10_column_bwt(spark, sf_dir)) == brute(sorted(documents))


@pytest.mark.parametrize("text", ["ab" * 400, "x" * 1000, "abc" * 50 + "q" + "abc" * 60])
def test_periodic(spark, text):
    docs = [(1, text), (2, "pre" + text[:300] + "post"), (3, text[::-1])]
    assert found(M.repeated_bytes(spark.createDataFrame(docs, "doc_id bigint, text string"), 20, 10)) == brute(docs, 20)


def test_odd_rows(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    docs.sort(key=lambda r: (r[0] is None, r[0] or 0))
    assert found(M.repeated_bytes(odd)) == brute(docs)
    assert M.repeated_bytes(none).count() == 0


def test_hot_anchors(spark, documents, monkeypatch):
    from pyspark import cloudpickle

    monkeypatch.setattr(M, "HOT", 3)
    cloudpickle.register_pickle_by_value(M)
    try:
        assert found(M.repeated_bytes(spark.createDataFrame(documents, "doc_id bigint, text string"))) == brute(sorted(documents))
    finally:
        cloudpickle.unregister_pickle_by_value(M)


def test_one_long_text_with_a_hot_anchor(spark):
    import random

    rng = random.Random(11)
    phrase = "".join(rng.choices("abcdefghij", k=70))
    text = "".join(phrase + "".join(rng.choices("klmnopqrstuvwxyz", k=45)) for _ in range(M.HOT + 900))
    docs = [(1, text), (2, text[1000:1400])]
    assert found(M.repeated_bytes(spark.createDataFrame(docs, "doc_id bigint, text string"))) == brute(docs)

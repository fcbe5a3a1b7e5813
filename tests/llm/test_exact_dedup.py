import hashlib
import random
import string

from heronry.llm import exact_dedup as M

from ..differential import duck, rows


def test_fingerprints_compose():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3 * M.CHUNK + 17))
    parts = M.chunk_hashes(M.np.frombuffer(data, M.np.uint8))
    a, b = M.combine(parts[:2]), M.combine(parts[2:])
    assert M.combine([a, b]) == M.combine(parts)
    h = 0
    for x in data:
        h = (h * M.BASES[0] + x + 1) % M.PRIMES[0]
    assert h == M.combine(parts)[0]


def test_query(spark, sf_dir):
    assert rows(M.op1_exact_dedup(spark, sf_dir)) == duck(sf_dir, M.SQL)


def test_odd_rows(odd, none):
    got = {}
    for r in M.exact_dedup(odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert (got[0][0].keep_id, got[0][0].group_size, got[0][0].kept) == (1, 2, False) and got[1][0].kept
    assert {got[k][0].text_sha256 for k in (2, 3)} == {hashlib.sha256(b"").hexdigest()} and got[2][0].keep_id == 3
    assert sorted(r.kept for r in got[5]) == [False, True] and got[5][0].group_size == 2
    assert got[None][0].kept
    assert M.exact_dedup(none).count() == 0
    assert M.keep_one(odd).count() == 8 and M.keep_one(odd).columns == odd.columns


def test_a_false_fingerprint_is_split(spark, monkeypatch):
    monkeypatch.setattr(M, "fingerprint", lambda data: (0, len(data)))  # only lengths tell texts apart
    texts = ["".join(random.Random(k % 3).choices(string.ascii_lowercase, k=50)) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(1)
    prints = [(i, fp, n, hashlib.sha256(t.encode()).digest()) for (i, t), (fp, n) in zip(enumerate(texts), [(0, 50)] * 6)]
    assert len({p[3] for p in prints}) == 3
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(M)
    try:
        got = {r.doc_id: r.keep_id for r in M.exact_dedup(docs).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(M)
    assert got == {k: 3 + k % 3 for k in range(6)}

import numpy as np
import pytest

from heronry.operators import search, vector_index
from heronry.plans import catalogue


def recall(found, exact):
    near = {}
    for r in exact:
        near.setdefault(r.query_id, set()).add(r.item_id)
    return sum(r.item_id in near[r.query_id] for r in found) / sum(map(len, near.values()))


def frame(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(range(len(v)) if ids is None else ids, v, strict=True)], "item_id bigint, vector array<float>")


def clustered(rng, n, dims=24, centres=40):
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, dims))


def test_whole_query(spark):
    """All embeddings of sf0.1, against plain cosines: recall, exact scores and order."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = [r.vec_id for r in rows]
    near = np.round(np.maximum(0, u @ u.T), 6)
    got = catalogue.QUERIES["vector_index_topk"](spark, d).collect()
    best = {q: sorted(zip(-near[k], ids, strict=True))[:18] for k, q in enumerate(ids) if q % 100 == 0}
    assert {r.query_id for r in got} == set(best) and len(got) == 18 * len(best)
    assert sum(r.item_id in {i for _, i in best[r.query_id]} for r in got) / len(got) >= 0.9
    at = {i: k for k, i in enumerate(ids)}
    assert all(abs(r.raw - near[at[r.query_id], at[r.item_id]]) < 2e-6 for r in got)


@pytest.mark.parametrize("kind", ["clustered", "none"])
def test_recall_and_work(spark, kind):
    rng = np.random.default_rng(7)
    v = clustered(rng, 6000) if kind == "clustered" else rng.normal(size=(6000, 24))
    corpus = frame(spark, v)
    q = corpus.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    index = vector_index.build(corpus)
    assert index.packs.selectExpr("sum(size(ids))").first()[0] == 6000
    exact = search.vector(q, corpus).collect()
    assert recall(vector_index.search(q, index).collect(), exact) >= 0.9
    assert sorted(vector_index.search(q, index, exact=True).collect()) == sorted(exact)
    if kind == "clustered":
        assert index.read < 0.1
    assert vector_index.candidates(q, index, 18 * vector_index.RERANK, index.probes).count() <= 60 * 18 * vector_index.RERANK < 60 * 6000 / 10


def test_odd_vectors(spark):
    v = [[1.0, 0.0], [0.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [3.0, 4.0]]
    corpus = frame(spark, v).union(spark.createDataFrame([(9, None)], "item_id bigint, vector array<float>"))
    q = corpus.where("item_id IN (0, 1)").withColumnRenamed("item_id", "query_id")
    got = sorted((r.query_id, r["rank"], r.item_id, r.raw) for r in vector_index.search(q, corpus).collect())
    assert got == [(0, 1, 0, 1.0), (0, 2, 2, 1.0), (0, 3, 4, 0.6), (0, 4, 1, 0.0), (0, 5, 3, 0.0), *((1, k + 1, k, 0.0) for k in range(5))]
    assert vector_index.search(q, corpus.limit(0)).count() == 0 and vector_index.search(q.limit(0), corpus).count() == 0


def test_best_chunk(spark):
    rng = np.random.default_rng(8)
    v = clustered(rng, 2000)
    chunks = frame(spark, v).selectExpr("item_id AS chunk_id", "item_id % 300 AS item_id", "vector")
    q = frame(spark, v).where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    exact = search.best_chunk(q, chunks).collect()
    assert recall(vector_index.best_chunk(q, chunks).collect(), exact) >= 0.9


def test_facts_in_use(spark, sf_dir):
    from heronry.plans import bridge

    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    in_use = [r.atom_id for r in bridge.atoms(spark, sf_dir).where("status = 'active'").collect() if r.atom_id in rows]
    got = catalogue.QUERIES["atom_vector_index"](spark, sf_dir).collect()
    found = 0
    for q in (i for i in rows if i % 100 == 0):
        near = sorted((-max(0.0, round(float(rows[q] @ rows[i] / np.linalg.norm(rows[q]) / np.linalg.norm(rows[i])), 6)), i) for i in in_use)[:18]
        found += len({i for _, i in near} & {r.item_id for r in got if r.query_id == q})
    assert {r.item_id for r in got} <= set(in_use) and found >= 0.9 * len(got) > 0
